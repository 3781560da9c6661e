"""Ranks, quantiles and prefixes of hot groups against plain sorting."""

import math

from pyspark.sql import functions as F

from logloom.operators import ranks, segment


def _rows():
    rows = [("hot", [0, 5, 5, 7, 1000000][i % 5] + (i % 11 == 0) * i, i * 9001) for i in range(700)]
    return rows + [(None, 3, 1), (None, 3, 70000), (None, 1, 5), ("one", 0, 0)]


def test_ranks_of_a_hot_group(spark):
    df = spark.createDataFrame(_rows(), "g string, v bigint, t bigint")
    got = {(r.g, r.t): r.rank for r in ranks.grouped_rank(df, ["g"], "v", "t").collect()}
    want = {}
    for g in ("hot", None, "one"):
        for k, (_, _, t) in enumerate(sorted((r for r in _rows() if r[0] == g), key=lambda r: r[1:]), 1):
            want[g, t] = k
    assert got == want
    assert ranks.grouped_rank(df.limit(0), ["g"], "v", "t").count() == 0


def test_values_at_ranks(spark):
    values = [("a", x / 7 - 30) for x in range(401)] + [("a", 0.0)] * 300 + [("a", None), (None, -2.5), (None, 4.0)]
    df = spark.createDataFrame(values, "g string, v double")
    asked = {"first": lambda n: F.lit(1), "p95": lambda n: F.ceil(0.95 * n), "last": lambda n: n, "beyond": lambda n: n + 1}
    for r in ranks.value_at_ranks(df, ["g"], "v", asked).collect():
        own = sorted(v for g, v in values if g == r.g and v is not None)
        assert (r.n, r.first, r.p95, r["last"], r.beyond) == (len(own), own[0], own[math.ceil(0.95 * len(own)) - 1], own[-1], None)


def test_prefixes_stop_at_the_first_overflow(spark):
    rows = [("a", i * 1000, 10 + i % 7) for i in range(200)] + [(None, 5, 3), (None, 9, 2), ("b", 1, 500), ("b", 2, 1)]
    df = spark.createDataFrame(rows, "g string, i bigint, n bigint")
    got = {(r.g, r.i): r.used_bytes for r in segment.prefix_fit(df, ["g"], "i", F.col("n"), 300).collect()}
    want = {}
    for g in ("a", None, "b"):
        used = 2
        for _, i, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            used += n + 1
            if used > 300:
                break
            want[g, i] = used
    assert got == want


def test_range_rank_spreads_a_group(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), rng.choice([1.5, 2.5, None]), k) for k in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.range_rank(spark.createDataFrame(rows, "g string, v double, k long").repartition(3), ["g"], [F.desc_nulls_last("v"), F.asc("k")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [tuple(r)[:3] for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == own
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(1, len(own) + 1))
