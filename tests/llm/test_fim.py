import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import fim

SCHEMA = "doc_id long, text string, n long, output string, h1 long, row string, cut string"
TEXTS = [None, "", " ", "a", "ab cd", "é漢字🙂 don't\n\n x", "x" * 20_000, "1 2 3 " * 40_000, "has <P> inside", "<S>", "near <P and S> ", "<", "A<\nS>"]


def naive(doc_id, text):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(v % (len(u) + 1) for v in h[:2])
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def rows_of():
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abZ 9.\n<é🙂") for _ in range(rng.randint(1, 90))) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, rng.choice(texts)) for k in range(200)]
    return rows + [(None, "a b"), (None, None), (3, "a"), (3, "a"), (4, "other")]


def test_against_plain_cutting(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, 7, "o", 1, "r", "c") for i, t in rows], SCHEMA).repartition(3)
    got = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, t, *naive(i, t)) for i, t in rows), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_carried_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "o", 1, "r", "c")], SCHEMA)
    assert fim.fill_in_middle(docs, carry=["h1", "row", "cut"]).first().row == "r"
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, carry=["output"])
    assert fim.fill_in_middle(docs.where("false")).collect() == []


def test_texts_that_share_a_hash_are_told_apart():
    import pandas as pd

    same = pd.Series([1, 1, 1, 1])
    texts = pd.Series(["a b c", "abc", "abc", "a b c"])
    (out,) = list(fim.cuts.func(iter([(same, same, texts, pd.Series([1] * 4), pd.Series([10**9] * 4))])))
    assert out["n"].tolist() == [5, 1, 1, 5]


@given(st.lists(st.integers(1, 3000), max_size=400))
@settings(max_examples=60, deadline=None)
def test_elias_fano_selects(steps):
    values = np.cumsum(np.array(steps, np.int64))
    index = fim.EliasFano(values)
    assert [index.end(k) for k in range(len(values) + 1)] == [0, *values.tolist()]
    if len(values):
        assert len(index.low) + index.high.nbytes <= (2 + np.log2(max(1, values[-1] / len(values)))) * len(values) / 8 + 17


@given(st.text(alphabet="abZ 9.é🙂", max_size=60))
@settings(max_examples=60, deadline=None)
def test_units(text):
    assert fim.unit_ends(text).tolist() == [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
