"""The registered queries, digest columns included, against plain re-computation."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from logloom.llm import langid, mil, queries, quality_rules
from logloom.llm.shingles import mixed, shingle_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    made = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = [None, "", " \n ", "one", "a b c d e", "é 漢字🙂 don't\n\n x"] + [made(rng.randint(1, 200)) for _ in range(30)]
    rows = [(k, t, ["en", "de"][k % 2], [None, "a", "b"][k % 3], len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[8], (None, made(30), "en", "a", 0), (8, made(20), "de", "a", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
    return at, rows


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def naive_print(text):
    """One signed vote of each term for each bit."""
    votes = np.zeros(256, dtype=np.int64)
    for h in shingle_hashes(text):
        for lane in range(4):
            word = int(mixed(np.array([h], np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (lane + 1) & 0xFFFFFFFFFFFFFFFF))[0])
            for byte in range(8):
                for bit in range(8):
                    votes[64 * lane + 8 * byte + bit] += 1 if word >> (8 * byte) & 0xFF & (0x80 >> bit) else -1
    return np.packbits(votes > 0).tobytes().hex()


def test_op7_by_signed_votes(spark, tables):
    at, rows = tables
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = queries.op7_simhash(spark, at).collect()
    assert len(got) == len(rows)
    single = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 256
    for k, r in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)]
        if r[0] in single and following[0] in single:
            t, nxt = r[1] or "", following[1] or ""
            changed = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            g = next(x for x in got if x.doc_id == r[0])
            assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(t), sha(changed), naive_print(t), naive_print(changed)), r[0]
            assert (g.near_edited, g.near_next) == pytest.approx((like(g.fingerprint, g.edited_fingerprint), like(g.fingerprint, naive_print(nxt))))


def test_op5_digests_are_the_library_s(spark, tables):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at, rows = tables
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.op5_bpe_automaton(spark, at).collect()), key=str) == sorted(want, key=str)


def test_op10_takes_what_targets_say(spark, tables):
    at, rows = tables
    got = queries.op10_block_mixture(spark, at).collect()
    size = lambda t: len((t or "").encode().split())
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((r[0], size(r[1])) for r in rows if r[0] is not None) and len(got) == len(rows)
    names = ["a", "b", None]
    own = [sum(size(r[1]) for r in rows if r[3] == s) for s in names]
    left, goal, free = float(sum(own)), {}, list(range(3))
    while free:  # shares by weight 5, 2, 1, at most three times a source's size
        weight = sum((5, 2, 1)[k] for k in free)
        full = [k for k in free if left * (5, 2, 1)[k] / weight > 3 * own[k]]
        for k in full or free:
            goal[k] = 3.0 * own[k] if full else left * (5, 2, 1)[k] / weight
        left, free = left - sum(goal[k] for k in full), [k for k in free if k not in goal]
    source = {(r[0], size(r[1])): r[3] for r in rows}
    taken = {s: 0 for s in names}
    for r in got:
        s = source[r.doc_id, r["size"]]
        taken[s] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == own[names.index(s)] and r.target == pytest.approx(goal[names.index(s)])
    assert all(abs(taken[s] - goal[k]) <= 64 for k, s in enumerate(names))


def test_op8_by_plain_decoding(spark, tables):
    at, rows = tables
    train = [(r[1], r[2]) for r in rows if r[1] is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 != 1]
    model = queries.langid.train(spark.read.parquet(f"{at}/documents.parquet").where(queries.crc_mod(queries.F.col("doc_id"), 3) != 1))
    assert model.languages == sorted({lang for _, lang in train})
    for r in queries.op8_language_codes(spark, at).collect():
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    text = "gabbed faced"
    m = model.slope * model.margins(text) + model.offset
    losses = [sum(w * np.log1p(np.exp(-c * x)) for w, c, x in zip(model.weight, code, m, strict=True)) for code in model.code]
    p = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
    lang, score, _ = model.predict(text)
    assert lang == model.languages[int(np.argmax(p))] and score == pytest.approx(p.max())


def test_op8_flags_an_ambiguous_text():
    model = langid.fit(["aaa bbb aaa"] * 5 + ["ccc ddd ccc"] * 5, ["x"] * 5 + ["y"] * 5)
    assert model.predict("aaa bbb")[2] is False and model.predict("zzz qqq")[2] is True


def test_op1_by_plain_softmax():
    model = mil.AttentionMIL.new(5)
    text = " ".join("ab cd! EF 12".split() * 60)
    x = np.concatenate(list(mil.passages(text)))
    h = np.tanh(x @ model.E + model.e)
    s = [sum(model.w * (np.tanh(row @ model.V) / (1 + np.exp(-(row @ model.U))))) for row in h]
    a = np.exp(s) / np.exp(s).sum()
    assert len(x) > 2 and model.score(text) == pytest.approx(1 / (1 + np.exp(-(model.c @ (a @ h) + model.d[0]))))


def test_op2_removes_common_lines(spark):
    rows = [(k, f"Shared  line\nown {k}\n\nshared line\t", "h") for k in range(4)] + [(9, "shared line\nx", "other"), (None, None, None), (1, "Shared  line\nown 1\n\nshared line\t", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.source, r.cleaned_text, r.removed_lines) for r in quality_rules.without_common_lines(docs, max_docs=3).collect()), key=str)
    assert got == sorted([(k, "h", f"own {k}\n", 2) for k in (0, 1, 1, 2, 3)] + [(9, "other", "shared line\nx", 0), (None, None, "", 0)], key=str)
    assert quality_rules.without_common_lines(docs.limit(0)).count() == 0


def test_op3_keeps_repeated_rows_and_follows_record_ids(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "u", "x"), (1, "v", "x"), (2, "u", "x"), (3, None, None), (4, "v", ""), (None, "n", "x"), (None, "n", "y"), (None, "n", "y"), (7, "w", "é"), (6, "w", "é")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in queries.op3_warc_transactions(spark, str(tmp_path)).collect()), key=repr)
    want = [(1, 1, "response", None)] + [(p, 1, "revisit", 1) for p in (1, 1, 1, 2, None)] + [(3, 0, "response", None), (4, 0, "revisit", 3)]
    want += [(None, 1, "response", None)] * 2 + [(6, 2, "response", None), (7, 2, "revisit", 6)]
    assert got == sorted(want, key=repr)


def test_op3_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op3_warc_transactions(spark, str(tmp_path)).collect() == []
