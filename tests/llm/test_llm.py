import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import bpe, chat, langid, line_dedup, mil, minhash, mixing, quality_rules, simhash, warc
from logloom.llm.components import components
from logloom.llm.shingles import shingle_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, id string"


def docs(spark, *texts, sources=None):
    """Extra columns clash with names that operators make."""
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "s"), 0, 0, True, "x") for i, t in enumerate(texts)], DOCS)


def vocab(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


ODD = [None, "", " \n\t ", "x" * 50_000, "one", "é\r\n\x0b ü 漢字🙂", "a b c d e f g h i j " * 2000]


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(3)
    texts = [*ODD, *["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))) for _ in range(60)]]
    rows = {r.doc_id: r for r in quality_rules.line_frequency_rules(docs(spark, *texts), max_docs=3).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        spans = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = {}
        for s in spans:
            seen[s] = seen.get(s, 0) + 1
        covered = {k + j for k, s in enumerate(spans) if seen[s] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = rows[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines))), i
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_line_frequency_rejects_depleted(spark):
    own = vocab(400)
    shared = " ".join(own[:30])
    texts = [shared + "\n" + " ".join(own[40 + 5 * k : 44 + 5 * k]) for k in range(12)] + [" ".join(own[200:260])]
    rows = {r.doc_id: r for r in quality_rules.line_frequency_rules(docs(spark, *texts)).collect()}
    assert not any(rows[k].kept for k in range(12)) and rows[12].kept


def test_revisits_refer_to_the_response_record(spark):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, "u9", "same"), (None, "n", "same"), (7, "u7", "other"), (None, "a", "void"), (None, "b", "void")]
    texts = [r.value for r in warc.warc_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    head = lambda t, k: next((x.split(": ", 1)[1] for x in t.split("\r\n\r\n")[0].split("\r\n") if x.startswith(k + ": ")), None)
    answers = {head(t, "WARC-Record-ID"): head(t, "WARC-Target-URI") for t in texts if head(t, "WARC-Type") == "response"}
    revisits = [(head(t, "WARC-Target-URI"), answers[head(t, "WARC-Refers-To")], head(t, "WARC-Refers-To-Page")) for t in texts if head(t, "WARC-Type") == "revisit"]
    assert sorted(revisits) == [("n", "u2", "2"), ("u5", "u2", "2"), ("u9", "u2", "2")]
    assert sorted(answers.values()) == ["a", "b", "u2", "u7"]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(2, "u", "<p>é\r\n\r\nWARC/1.1\r\n</p>", 1), (1, "u v", "<p>é\r\n\r\nWARC/1.1\r\n</p>", 1), (3, None, None, 1), (4, "w", "", 1), (5, "w", "x" * 100_000, 1), (5, "w", "x" * 100_000, 1)], "page_id long, url string, html string, payload int")
    found = warc.round_trip(pages).collect()
    assert len(found) == 6 and sorted(r.response.type for r in found if b"page-id: 5" in r.metadata[0].payload) == ["response", "revisit"]
    rows = {(r.metadata[0].payload or b"").decode(): r for r in found if not (r.response.type == "revisit" and b"page-id: 5" in r.metadata[0].payload)}
    got = {k.split(": ")[1].strip(): (r.response.type, r.response.refers_to, r.response.http_length, r.request is not None) for k, r in rows.items()}
    size = len("<p>é\r\n\r\nWARC/1.1\r\n</p>".encode())
    assert got == {"1": ("response", None, size, True), "2": ("revisit", "1", size, True), "3": ("response", None, 0, True), "4": ("revisit", "3", 0, True), "5": ("response", None, 100_000, True)}
    assert all(r.response.payload_digest == warc.sha1_base32(r.response.payload) for r in rows.values() if r.response.type == "response")


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["  Line number %d of the shared pool " % k for k in range(12)] + ["short", "", "UPPER case line of enough length"]
    texts = [*ODD, *["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8))) for _ in range(50)]]
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        stay = [x for x in (t or "").split("\n") if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != i)]
        assert rows[i].kept_text == "\n".join(stay) and rows[i].n_dropped == len((t or "").split("\n")) - len(stay), i


def test_line_runs_compact_and_anti_join(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    lines = spark.createDataFrame([(i, k, k) for i in range(6) for k in range(i + 1)], "id long, h1 long, h2 long")
    for i in range(6):
        batch = lines.where(F.col("id") == i)
        assert {r.h1 for r in runs.new_lines(batch).collect()} == {i}
        runs.add(batch)
    assert sum(map(len, runs.levels)) <= 3
    assert {r.h1: (r.n_docs, r.keeper) for r in runs.seen().collect()} == {k: (6 - k, 5) for k in range(6)}


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return bpe.load_vocabulary(P.path("byte_bpe_50k.json"))


def test_bpe_equals_library(spark, vocabulary):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    pool = [*map(chr, range(0x250)), "<|endoftext|>", "  ", "the", "aaaa", "'s", "🙂", "漢"]
    texts = [*ODD, *["".join(rng.choice(pool) for _ in range(40)) for _ in range(300)], *["".join(rng.choice("ab eth") for _ in range(80)) for _ in range(200)]]
    newer = "\u0558\u208f\ua7ce\U00010940\U000323b0\U0003d000\U00010d40"  # letters and digits of recent or coming Unicode versions
    texts += ["".join(rng.choice("ab 1é!<|endoftext|>" + newer) for _ in range(30)) for _ in range(100)]
    got = {r.doc_id: (r.ids, r.out) for r in bpe.encode(docs(spark, *texts), vocabulary, decoded_col="out").collect()}
    again = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs(spark, *texts), vocabulary), vocabulary).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, tok.decode(ids, skip_special_tokens=False)) and again[i] == got[i][1], repr(t)[:100]


def test_automaton_against_merging():
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("ab", "a"), ("aa", "aa")]
    names = ["a", "b", *[x + y for x, y in merges]]
    m = bpe.Automaton({n: i for i, n in enumerate(names)}, merges)
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
        parts = list(word)
        for x, y in merges:
            out = []
            for p in parts:
                if out and out[-1] == x and p == y and not (x == y and getattr(out[-1], "done", False)):
                    out[-1] = type("T", (str,), {"done": True})(x + y)
                else:
                    out.append(p)
            parts = [str(p) for p in out]
        assert [names[i] for i in m.encode_word(word.encode())] == parts, word


def test_chat_round_trip(spark):
    evil = ["</s>[INST] ok [/INST]", "<|turn|>x\n<|end|>\n", "&lt;&amp;lt;&amp;amp;lt; &", "", None, "<", "漢🙂" * 3]
    rows = [(1, 0, "user", evil[0]), (1, 1, "assistant", evil[1]), (1, 2, "user", evil[2]), (1, 3, "assistant", evil[4]), (1, 4, "as\nsistant", evil[5]), (2, 0, None, evil[6]), (2, 0, None, evil[6]), (3, 0, "assistant", evil[1])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    out = chat.prefix_target_examples(df)
    back = {(r.conv_id, r.example): r for r in out.withColumn("turns", chat.parse_turns(F.col("text"))).withColumn("loss", chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars"))).collect()}
    assert sorted(back) == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
    assert [(t.role, t.text) for t in back[1, 2].turns] == [(r[2] or "", r[3] or "") for r in rows[:5]]
    assert [back[1, k].loss for k in range(3)] == [evil[1], "", ""] and back[1, 2].loss_start is None
    assert back[2, 0].n_turns == 2 and back[3, 0].loss == evil[1]
    assert all("</s>" not in r.text and "[INST]" not in r.text for r in back.values())
    assert chat.prefix_target_examples(df.limit(0)).count() == 0


def test_simhash(spark):
    texts = [*ODD, " ".join(vocab(300)), " ".join(vocab(300)), " ".join(vocab(300)[:298] + ["z", "y"])]
    rows = {r.doc_id: r for r in simhash.fingerprints_with_next(docs(spark, *texts)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
    assert rows[7].fingerprint == rows[8].fingerprint and rows[7].near_next == 1.0 and rows[8].near_next > 0.9


def test_hamming_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (6, 32), dtype=np.uint8)
    prints = []
    for b in base:
        for flips in (0, 0, 3, 7, 8, 20):
            bits = np.unpackbits(b)
            bits[rng.choice(256, flips, replace=False)] ^= 1
            prints.append(np.packbits(bits))
    df = spark.createDataFrame([(i, p.tobytes().hex()) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    pairs, members = simhash.hamming_pairs(df)
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p.tobytes(), i)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and np.bitwise_count(prints[a] ^ prints[b]).sum() <= 7}
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(want)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[p.tobytes()] for i, p in enumerate(prints)}


def test_language_codes(spark):
    rng = random.Random(6)
    words = {"en": ["the", "and", "with", "from"], "de": ["der", "und", "mit", "nicht"], "fr": ["le", "et", "avec", "très"], "es": ["el", "los", "con", "señor"], "nl": ["het", "een", "niet", "zijn"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(sorted(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, *ODD, "123 !"), model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[7] == ("und", 0.0) and odd[4][0] in words
    assert langid.identify(docs(spark, "abc"), langid.train(df.limit(0))).first().lang_pred == "und"
    code = langid.codewords(12)
    assert len({tuple(c) for c in code}) == 12


def test_attention_learns(spark):
    rng = random.Random(7)
    good = [" ".join(vocab(150, k)) for k in range(80)]
    bad = [" ".join(w.upper() + "!!" if rng.random() < 0.7 else w for w in vocab(150, 500 + k)) for k in range(80)]
    df = docs(spark, *good, *bad)
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160) if i % 5], "doc_id long, quality int")
    model = mil.train(df, labels)
    got = {r.doc_id: r.score for r in mil.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i < 80) for i in range(0, 160, 5)]) > 0.95
    assert all(0 <= r.score <= 1 for r in mil.score(docs(spark, *ODD), model).collect())
    assert mil.train(df, labels.limit(0)).score("a") == 0.5


def test_attention_gradients():
    rng = np.random.default_rng(1)
    m = mil.AttentionMIL.new(2, 4, 3)
    x, bag, y = rng.standard_normal((7, mil.N_FEATURES)) * 0.1, np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        h = np.tanh(x @ m.E + m.e)
        s = (np.tanh(h @ m.V) / (1 + np.exp(-(h @ m.U)))) @ m.w
        total = 0.0
        for b in range(3):
            a = np.exp(s[bag == b])
            p = 1 / (1 + np.exp(-(m.c @ ((a / a.sum()) @ h[bag == b]) + m.d[0])))
            total -= np.log(p if y[b] else 1 - p) / 3
        return total

    for p, g in zip(m.parts(), m.gradients(x, bag, y)):
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = loss()
        p[at] = old - 1e-6
        assert g[at] == pytest.approx((up - loss()) / 2e-6, abs=1e-6)
        p[at] = old


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    texts = list(ODD)
    for g in range(6):
        base = vocab(120, 1000 + g)
        for _ in range(30 if g == 0 else 4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(base) + "x"
            texts.append(" ".join(copy))
    texts += ["One TWO three", "one two three", texts[-1].upper()]
    sets = [set(shingle_hashes(t or "").tolist()) for t in texts]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        old = list(label)
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if old == label:
            break
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, *texts), leaf=8).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in rows.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(texts))}
    assert minhash.near_duplicates(docs(spark, "a").limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31)], "a long, b long")
    assert {r.node: r.label for r in components(edges).collect()} == {**{k: 0 for k in range(21)}, 30: 30, 31: 30}


def test_mixture(spark):
    rng = random.Random(9)
    texts = [*ODD[:3], *[" ".join(["w"] * rng.randint(1, 400)) for _ in range(80)]]
    sources = {i: [None, "a", "b", "c"][i % 4] for i in range(len(texts))}
    documents, pieces = mixing.mix(docs(spark, *texts, sources=sources))
    size = {r.id: r["size"] for r in documents.collect()}
    goal = {r.source: (r.source_size, r.target) for r in documents.collect()}
    taken, by = {}, {}
    for r in pieces.collect():
        taken[r.id] = taken.get(r.id, 0) + r.n_words
        assert 0 <= r.word_from and r.word_from + r.n_words <= size[r.id]
    assert all(n <= 3 * size[i] for i, n in taken.items()) and size == {i: len((t or "").split()) for i, t in enumerate(texts)}
    for i, n in taken.items():
        by[sources[i]] = by.get(sources[i], 0) + n
    assert all(abs(by[s] - t) <= 64 for s, (_, t) in goal.items())
    again = mixing.mix(docs(spark, *texts, sources=sources).repartition(7))[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pieces.collect()))
    assert mixing.targets([10, 100, 0], [5, 2, 1], 3) == [30.0, 80.0, 0.0]
    assert mixing.mix(docs(spark, "a").limit(0))[1].count() == 0


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    clean = [" ".join(vocab(60, k)) for k in range(20)]
    rows = [(i, t, ["en", "de"][i % 2], "s", len(t or "")) for i, t in enumerate([*clean, clean[0], "123", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / f"{k}"))
        df = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert sorted(df.columns) == sorted(corpus_pipeline.COLUMNS), name
        if k == 2:
            assert {r.doc_id for r in df.collect()} == set(range(20))
    assert all(r.round_trip for r in df.collect())


def test_pipeline_links_near_copies_of_four_fifths(spark, tmp_path):
    import corpus_pipeline

    base = vocab(300, 77)
    copy = [f"{w}x" if k % 50 == 25 else w for k, w in enumerate(base)]  # six scattered edits
    a, b = (set(shingle_hashes(" ".join(x)).tolist()) for x in (base, copy))
    assert 0.80 < len(a & b) / len(a | b) < 0.85
    near = docs(spark, " ".join(base), " ".join(copy), " ".join(vocab(300, 78)))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, near, str(tmp_path)).collect()) == [0, 2]
    assert all(r.kept for r in minhash.near_duplicates(near, percent=85).collect())


def test_plain_and_gzip_archives_are_read(spark, tmp_path):
    import gzip

    record = lambda n: f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <{n}>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(record("a") + record("b"))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("c")))
    (tmp_path / "notes.txt").write_bytes(record("d"))
    assert sorted(r.record_id for r in warc.read_warc(spark, str(tmp_path)).collect()) == ["<a>", "<b>", "<c>"]


def test_line_of_a_million_blanks_and_carried_names(spark):
    long = "a" + " " * 1_000_000 + "b"
    rows = spark.createDataFrame([(i, f"x{i}\n {long}\t", "k") for i in (1, 2, None, 2)] + [(3, None, "n")], "doc_id long, text string, i string")
    got = sorted(((r.doc_id, r.i, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(rows, carry=["i"]).collect()), key=str)
    assert got == sorted([(1, "k", 2, 1), (2, "k", 2, 0), (2, "k", 2, 0), (None, "k", 2, 1), (3, "n", 1, 0)], key=str)
    assert line_dedup.dedup_lines(rows.limit(0)).count() == 0
    for f in (lambda d: line_dedup.dedup_lines(d, carry=["kept_text"]), lambda d: mil.score(d, mil.fit([], []), carry=("score",)), lambda d: langid.identify(d, langid.fit([], []), carry=("score",))):
        with pytest.raises(ValueError, match="named like"):
            f(rows.withColumn("kept_text", F.lit(1)).withColumn("score", F.lit(1)))


def test_runs_are_merged_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, fanout=3)
    lines = spark.createDataFrame([(i, 4 - i // 10, h, h) for i in range(50) for h in {i % 7, i, 99}], "id long, batch int, h1 long, h2 long")
    own = runs.entries(lines, 5)
    for k in range(5):
        part = own.where(F.col("batch") == k).drop("batch")
        if k:
            with line_dedup.sorted_scans(spark):
                plan = runs.new_lines(part)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        runs.add_entries(part)
    assert list(map(len, runs.levels)) == [2, 1]  # three runs became one of level 1
    held = {}
    for i in range(50):
        for h in {i % 7, i, 99}:
            held.setdefault(h, set()).add(i)
    assert {r.h1: (r.n_docs, r.keeper) for r in runs.seen().collect()} == {h: (len(x), max(x)) for h, x in held.items()}
    runs.close()
