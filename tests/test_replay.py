"""Replays: both are one search, a round is written once, and an archive isn't moved by each round."""

from pyspark.sql import functions as F

from logloom.operators import clients, frontier
from logloom.plans import searches

ASKED = "conv_id long, step int, action string, acted long, pages map<string,int>, labels map<string,struct<choice:string,p:double>>, need string, refs array<string>, support array<string>"
SAID = "choice string, p double, need string, citation string, cited_step int, causes array<struct<ref:string,step:int>>, external_left int, read int"


def questions(spark, ids):
    return spark.createDataFrame([(c, c % 3, "inspect", 5, {}, {}, None, [f"s{c % 3}"], []) for c in ids], ASKED)


def answered(asked):
    said = [F.lit("introduces"), F.lit(0.9), F.lit("none"), F.lit(None), F.lit(None), F.array(), F.lit(0), F.lit(1)]
    kinds = [x.split(" ") for x in SAID.split(", ")]
    return asked.select("conv_id", "step", "action", *[v.cast(kind).alias(name) for v, (name, kind) in zip(said, kinds, strict=True)])


def test_a_recorded_round_is_written_once(spark, monkeypatch):
    calls, kept, keep = [], [], clients.kept_once
    monkeypatch.setattr(clients, "kept_once", lambda df: kept.append(1) or keep(df))
    told = clients.recorded(answered, calls)(questions(spark, range(5)))
    assert len(kept) == len(calls) == 1
    assert sorted(r.conv_id for r in told.collect()) == list(range(5)) and calls[0].select("call").distinct().collect() == [(5,)]
    assert set(clients.ANSWER) <= set(told.columns)


def test_an_archive_is_asked_where_it_lies(spark):
    asked, calls = questions(spark, range(-4, 6)), []
    clients.recorded(answered, calls)(asked).count()
    forged = calls[0].withColumn("digest", F.when(F.col("conv_id") == 3, F.sha2("digest", 256)).otherwise(F.col("digest")))
    late = forged.withColumn("call", F.when(F.col("conv_id") == -1, 6).otherwise(F.col("call")).cast("long"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = clients.replayed(late)(asked)
        assert {r.conv_id for r in told.collect()} == set(range(-4, 6)) - {3, -1}
        plan = told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 1  # the questions only


def test_both_replays_are_one_search(spark, tmp_path, monkeypatch):
    texts = ["please fix the failed test", "error: it failed again", None, "the test must pass, validation failed", "done", "requirement: repair it"]
    rows = [(c, t, ("user", "assistant")[t % 2], texts[(c + t) % 6]) for c in (-9, -2, 0, 1, 2, 3, 1 << 40) for t in range(4 + c % 9)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    began, search = [], frontier.search
    monkeypatch.setattr(frontier, "search", lambda *a, **b: began.append(1) or search(*a, **b))
    got = searches.search_replay(spark, str(tmp_path)).collect()
    assert {r.conv_id for r in got} == {r[0] for r in rows} and len(got) == 7
    assert all(r.same and r.stopped for r in got) and any(r.forged is not None for r in got)
    assert len(began) == 2
