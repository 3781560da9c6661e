import os
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import bpe, packing, queries

SCHEMA = "doc_id long, text string, start long, ids string, part long"


def price(length, window, short, shortest):
    return min(window - length, short if length & (length - 1) == 0 and shortest <= length else window - length)


def least(positions, penalties, window, short, shortest):
    """The least cost of cutting [0, positions[-1]), every earlier cut tried."""
    at, pen = [0, *positions], [0, *penalties]
    best = [0]
    for j in range(1, len(at)):
        best.append(pen[j] + min(best[i] + price(at[j] - at[i], window, short, shortest) for i in range(j) if at[j] - at[i] <= window))
    return best[-1]


@given(st.sampled_from([8, 32, 64]), st.lists(st.tuples(st.integers(1, 8), st.sampled_from([0, 2, 16])), min_size=1, max_size=150), st.integers(0, 9), st.integers(1, 50))
@settings(max_examples=150, deadline=None)
def test_windows_cost_least_however_they_come(window, steps, short, at_once):
    positions, penalties = np.cumsum([s for s, _ in steps]), np.array([p for _, p in steps])
    program, cuts = packing.Windows(window, short, 4), [0]
    for k in range(0, len(steps), at_once):
        program.add(positions[k : k + at_once], penalties[k : k + at_once])
        settled = program.settle().tolist()
        assert settled[0] == cuts[-1]
        cuts += settled[1:]
    cuts += program.finish().tolist()[1:]
    pen = dict(zip(positions.tolist(), penalties.tolist(), strict=True))
    assert cuts[-1] == positions[-1] and all(b - a <= window for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    told = sum(pen[b] + price(b - a, window, short, 4) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    assert told == least(positions.tolist(), penalties.tolist(), window, short, 4)


def library():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    tok.no_truncation(), tok.no_padding()
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1]


def texts_of(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "!", "\n"]) for _ in range(n))
    return [None, "", " ", "one", "é漢字🙂 don't\n\n x", "x" * 50_000, prose(20_000), "a b. " * 20_000] + [prose(rng.choice([5, 60, 600])) for _ in range(150)]


def check(rows, texts, encode, window):
    """Every id in one piece, sequences without gaps, documents in order within a partition's stream."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    assert sorted(docs) == [k for k, _ in texts]
    for k, t in texts:
        told, ids = sorted(docs[k], key=lambda r: r.start), encode(t)
        assert [r.start for r in told] == np.cumsum([0, *[r.length for r in told[:-1]]]).tolist() and all(r.doc_tokens == len(ids) for r in told)
        assert b"".join(r.ids for r in told) == struct.pack(f"<{len(ids)}I", *ids), k
        assert [r.sequence_id for r in told] == sorted(r.sequence_id for r in told)
    padding = 0
    for told in sequences.values():
        told.sort(key=lambda r: r.offset)
        assert [r.offset for r in told] == np.cumsum([0, *[r.length for r in told[:-1]]]).tolist()
        used = sum(r.length for r in told)
        assert used <= window
        padding += 0 if used & (used - 1) == 0 else window - used
    return padding / sum(r.length for r in rows)


def test_pieces_against_the_library(spark):
    encode, texts = library(), list(enumerate(texts_of(random.Random(2))))
    docs = spark.createDataFrame([(k, t, 9, "s", 9) for k, t in texts], SCHEMA).coalesce(1)
    rows = packing.pack(docs, bpe.load_vocabulary(queries.tokenizer_path())).collect()
    assert check(rows, texts, encode, 2048) < 0.02
    assert [r.asDict() for r in packing.pack(docs, bpe.load_vocabulary(queries.tokenizer_path())).collect()] == [r.asDict() for r in rows]
    small = packing.pack(docs.repartition(3), bpe.load_vocabulary(queries.tokenizer_path()), window=64, gap=16, shortest=8, short=4, horizon=100).collect()
    check(small, texts, encode, 64)


def test_repeated_and_null_ids_and_empty_table(spark):
    vocabulary = bpe.load_vocabulary(queries.tokenizer_path())
    docs = spark.createDataFrame([(None, "a b", 9, "s", 9), (1, "a b", 9, "s", 9), (1, "a b", 9, "s", 9), (None, None, 9, "s", 9)], SCHEMA)
    rows = packing.pack(docs, vocabulary).collect()
    assert sorted((r.doc_id is not None, r.length) for r in rows) == [(False, 1), (False, 3), (True, 3), (True, 3)]
    assert packing.pack(docs.where("false"), vocabulary).collect() == []
    assert packing.pack(docs, vocabulary, carry=("doc_id", "part")).first().part == 9
    with pytest.raises(ValueError):
        packing.pack(docs, vocabulary, carry=("doc_id", "start"))
    with pytest.raises(ValueError):
        packing.pack(docs, vocabulary, window=64)


def test_op11_rows(spark):
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables")
    encode = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    rows = queries.op11_queue_packing(spark, at).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = encode(texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) and r.doc_tokens == len(ids)


def test_cuts_fall_on_sentences():
    vocabulary = bpe.load_vocabulary(queries.tokenizer_path())
    tables, text = packing.sentence_tables(vocabulary), "One two. Three 3.14 four!\nFive six"
    own = bpe.Codec(*bpe.compiled(vocabulary))
    ids = np.append(own.encode([text])[0], 1)
    positions, penalties = packing.candidates(ids, np.array([len(ids)]), tables, 16, 128, 256)
    spelt = lambda n: own.tables.spell(ids[:n]).tobytes().decode()
    assert [spelt(p) for p in positions[:-1]] == ["One two.", "One two. Three 3.14 four!\n"] or [spelt(p) for p in positions[:-1]] == ["One two.", "One two. Three 3.14 four!", "One two. Three 3.14 four!\n"]
    assert penalties.tolist()[-1] == 0 and positions[-1] == len(ids)
