"""Spans, packing and excerpts: against SQL on the smallest tables, and against plain loops on planted texts."""

import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from logloom.operators import search, segment
from logloom.operators import spans as S
from logloom.plans import catalogue
from logloom.plans import spans as plans

TABLES = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalogue.queries().items() if f.__module__ == plans.__name__ and n in catalogue.oracle_sql()]
PACKERS = ["chunk_pack_sum", "chunk_pack_joined", "line_pack_volume", "clip_excerpt"]
ODD = ["", "a", "née " * 40, "界" * 90, '"\\\n\t' * 30, "😀x" * 25, "plain words of a step " * 12, "\x01" * 40]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f.split('.')[0]} as select * from '{TABLES}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES + [n for n in PACKERS if n in catalogue.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, TABLES)
    told = duck.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in told.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(told.fetchall(), key=str)


def _steps(spark):
    roles = [("user", "user (-> bot)"), ("assistant", "bot"), ("tool", "tool")]
    rows = [(c, i, *roles[((c or 0) + i) % 3], ODD[((c or 0) * 3 + i) % len(ODD)]) for c in (1, 2, None) for i in range(12)]
    return spark.createDataFrame(rows, "conv_id int, step int, role string, name string, content string"), rows


def _naive_spans(step, role, name, text, span, most):
    """The spans of one text, cut by a rule written apart: whole characters up to span bytes, halved while too large."""
    def cut(part, start):
        raw = part.encode()
        end = start + len(raw)
        shown = {"id": f"s{step}:{start}:{end}", "step": step, "start_byte": start, "end_byte": end, "sha256": hashlib.sha256(raw).hexdigest(), "name": name, "role": role, "content": part}
        n = len(json.dumps(shown, ensure_ascii=False, separators=(",", ":")).encode())
        if n > most and len(part) > 1:
            left = part[: len(part) // 2]
            return cut(left, start) + cut(part[len(left) :], start + len(left.encode()))
        return [(start, end, n)]

    out, part, start = [], "", 0
    for ch in text:
        if len((part + ch).encode()) > span:
            out += cut(part, start)
            start, part = start + len(part.encode()), ""
        part += ch
    return out + (cut(part, start) if part or not text else [])


def test_spans_and_segments_against_a_plain_loop(spark):
    steps, rows = _steps(spark)
    # a limit below a span and its frame, so that escapes force halvings
    index = S.span_index(steps, span_bytes=60, segment_bytes=240)
    packed = S.span_segments(index, segment_bytes=900, records=4)
    got = {}
    for r in packed.collect():
        got.setdefault(r.conv_id, {})[(r.step, r.start_byte, r.end_byte)] = (r.rendered_bytes, r.batch)
    halvings = 0
    for case in (1, 2, None):
        want, batch, used, n = {}, 0, 2, 0
        for _, step, role, name, text in sorted((r for r in rows if r[0] == case), key=lambda r: r[1]):
            pieces = _naive_spans(step, role, name, text, 60, 238)
            halvings += len(pieces) > len(segment.split_utf8(text, 60))
            for start, end, size in pieces:
                soft = start == 0 and ("(->" in name or role in ("user", "system"))
                if n and (used + size + 1 > 900 or n >= 4 or (soft and used >= 450)):
                    batch, used, n = batch + 1, 2, 0
                used, n = used + size + (n > 0), n + 1
                want[(step, start, end)] = (size, batch)
        assert got[case] == want
    assert halvings


def test_read_back_finds_forgeries_and_missing_steps(spark):
    steps, _ = _steps(spark)
    steps = steps.where("conv_id is not null")
    index = S.span_index(steps, span_bytes=40)
    assert S.read_back(index, steps, ["conv_id", "step"]).where("not valid").count() == 0
    forged = index.where("step = 2").withColumn("sha256", F.lit("0")).unionByName(index.where("step = 3").withColumn("step", F.lit(99)))
    read = S.read_back(forged, steps, ["conv_id", "step"])
    assert read.where("valid").count() == 0 and read.where("step = 99 and bytes is not null").count() == 0
    assert S.span_index(steps.limit(0)).count() == 0 and S.span_segments(index.limit(0)).count() == 0


def test_token_chunks_against_a_plain_loop(spark):
    steps, rows = _steps(spark)
    count = lambda t: len(t.split())
    got = {}
    for r in S.token_chunks(steps, "conv_id", "step", "content", 15, count, 3).collect():
        got.setdefault(r.conv_id, {})[(r.step, r.start_char, r.end_char)] = r.batch
    for case in (1, 2, None):
        want, batch, used, held = {}, 0, 0, []
        for _, step, _, _, text in sorted((r for r in rows if r[0] == case), key=lambda r: r[1]):
            todo, pieces = [(0, len(text))], []
            while todo:
                a, b = todo.pop(0)
                if count(text[a:b]) > 15 and b - a > 1:
                    todo[:0] = [(a, a + (b - a) // 2), (a + (b - a) // 2, b)]
                else:
                    pieces.append((a, b))
            assert "".join(text[a:b] for a, b in pieces) == text
            for a, b in pieces:
                n = count(text[a:b])
                if held and (used + n > 15 or len({*held, step}) > 3):
                    batch, used, held = batch + 1, 0, []
                used, held = used + n, [*held, step]
                want[(step, a, b)] = batch
        assert got[case] == want


def test_clips_by_bytes(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    budgets = (0, 1, 3, 5, 27, 30, 33, 50, 90)
    got = texts.select("t", *[segment.clip_bytes(F.col("t"), b).alias(f"c{b}") for b in budgets], *[segment.clip_middle(F.col("t"), b).alias(f"m{b}") for b in budgets]).collect()
    for r in got:
        for b in budgets:
            assert r[f"c{b}"] == r.t.encode()[:b].decode("utf-8", "ignore")
            assert r[f"m{b}"] == segment.clip_text(r.t, b)


def test_excerpts_around_signals_and_terms(spark):
    texts = ["界" * 70 + " an Error in parse", "nothing to see", "😀" * 60 + "x.py fixed x", "must " * 30 + "fail", "a-term aterm term. term/x TERM end", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = ["error|fail", "fix", "must"]
    c = S.signal_start(F.col("t"), patterns)
    first, last, content = S.excerpt_at(F.col("t"), c, 40)
    for r in df.select("t", first.alias("a"), last.alias("b"), content.alias("x")).collect():
        hit = next((m for p in patterns if (m := re.search(p, r.t, re.I))), None)
        at = max(hit.start() - 50, 0) if hit else 0
        want = r.t[at:].encode()[:40].decode("utf-8", "ignore")
        assert (r.a, r.b, r.x) == (len(r.t[:at].encode()), len((r.t[:at] + want).encode()), want)
    long = [("y " * 80 + "see a.b", "a.b", 164 - 90), ("y " * 80 + "axb a.b", "a.b", 164 - 90), ("z " * 60 + "Term", "term", 30), ("none", None, 0)]
    at = spark.createDataFrame([(t, w, n) for t, w, n in long], "t string, w string, n int")
    assert all(r.n == r.got for r in at.select("n", S.term_start(F.col("t"), F.col("w")).alias("got")).collect())


def test_pack_keeps_columns_and_counts_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.lit("x").alias("batch_note"), (F.col("id") % 5).alias("n"))
        got = segment.greedy_pack(rows, ["g"], ["id"], F.col("n"), 9, 4).orderBy("g", "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    group, batch, used, k = None, 0, 0, 0
    for r in got:
        if r.g != group:
            group, batch, used, k = r.g, 0, r.n, 1
        elif used + r.n > 9 or k >= 4:
            batch, used, k = batch + 1, r.n, 1
        else:
            used, k = used + r.n, k + 1
        assert r.batch == batch and r.batch_note == "x"
    assert len(got) == 500


def _plain_tournament(items, budget, percent):
    """items: (item, score, size, unsure) of one case; what is left, and why it ended."""
    items = sorted(items)
    while True:
        groups, used = [], 0
        for x in items:
            if not groups or used + x[2] > budget:
                groups, used = [*groups, []], 0
            groups[-1].append(x)
            used += x[2]
        if len(groups) == 1:
            return {(x[0], "final") for x in items}
        left = []
        for g in groups:
            mass, kept = 0, []
            for x in sorted(g, key=lambda x: (-x[1], x[0])):
                if mass * 100 >= percent * sum(y[1] for y in g):
                    break
                mass, kept = mass + x[1], [*kept, x]
            left += g if any(x[3] for x in kept) else kept
        if len(left) == len(items):
            return {(x[0], "final_context_ambiguity") for x in items}
        items = sorted(left)


def test_adaptive_tournament_against_a_plain_loop(spark):
    rows = [(c, i, (i * 37 + c * 11) % 23 + 1, 10 + (i * 7) % 15, c == 3 or (c == 2 and i % 13 == 0)) for c in range(1, 5) for i in range(40)]
    rows += [(9, i, 5, 30, False) for i in range(6)] + [(8, 0, 1, 500, False)]
    df = spark.createDataFrame(rows, "c int, i int, s int, n int, u boolean")
    got = {}
    for r in search.adaptive_tournament(df, "c", "i", "s", "n", "u", 60, 70).collect():
        got.setdefault(r.c, set()).add((r.i, r.status))
    want = {c: _plain_tournament([r[1:] for r in rows if r[0] == c], 60, 70) for c in {r[0] for r in rows}}
    assert got == want
    assert len({status for x in want.values() for _, status in x}) == 2
