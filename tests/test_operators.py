import json

import pytest
from pyspark.sql import functions as F

from logloom.functions.text import normalize_role, recipient
from logloom.operators import joins, metrics, policy, retrieval, search, segment
from logloom.sources import io

TORTURE = ["汉字🙂\\\n" * 200, '汉🙂\x00"\\\n' * 120, "", "ßİ", "🙂"]


@pytest.mark.parametrize("budget", [1, 3, 7, 2200])
@pytest.mark.parametrize("text", TORTURE)
def test_split_is_lossless(text, budget):
    parts = segment.split_utf8(text, budget)
    assert "".join(p[3] for p in parts) == text and parts[0][1] == 0 and parts[-1][2] == len(text.encode())
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
    assert all(len(p[3].encode()) <= max(budget, 4) for p in parts)


def test_clip():
    out = segment.clip_text("汉" * 1000, 200)
    assert len(out.encode()) <= 200 and segment.MARK in out and segment.clip_text("ab", 5) == "ab"


def steps(spark, *names):
    return spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "conv_id long, step long, name string")


def test_handoff_prefers_addressed(spark):
    out = {r.step: (r.handoff_step, r.addressed) for r in joins.handoff_asof(steps(spark, "Planner (-> Worker)", "Other (-> Someone)", "Worker", "Verifier")).collect()}
    assert out == {0: (None, False), 1: (0, False), 2: (0, True), 3: (1, False)}


def test_trace_two_hops(spark):
    h = joins.handoff_asof(steps(spark, "Boss (-> Planner)", "Planner (-> Worker)", "Worker"))
    out = joins.trace(h.select("conv_id", "step", "handoff_step"), h.where("step = 2").select("conv_id", "step"), "conv_id", "step", "handoff_step")
    assert sorted(r.reached for r in out.collect()) == [0, 1, 2]


def test_roles(spark):
    r = spark.createDataFrame([("  PLANNER  (-> Worker) ",), (None,)], "n string").select(normalize_role(F.col("n")).alias("a"), recipient(F.col("n")).alias("b")).collect()
    assert [(x.a, x.b) for x in r] == [("planner", "worker"), ("", "")]


@pytest.mark.parametrize("p, mass, want", [({"a": 0.94, "b": 0.03, "c": 0.02, "d": 0.01}, 0.9, "a"), ({c: 0.25 for c in "abcd"}, 0.9, "abcd"), ({"a": 0.6, "b": 0.2, "c": 0.2}, 0.7, "abc"), ({"a": 1.0, "b": 0.0}, 1.0, "ab")])
def test_adaptive_set(spark, p, mass, want):
    df = spark.createDataFrame([("q", k, v) for k, v in p.items()], "question string, option string, p double")
    assert sorted(r.option for r in policy.adaptive_set(df, mass).collect()) == sorted(want)


def test_calibration(spark):
    a = spark.createDataFrame([(i, o, p) for i in range(20) for o, p in (("a", 0.8), ("b", 0.2))], "question long, option string, p double")
    t = spark.createDataFrame([(i, "k", "a") for i in range(20)], "question long, kind string, truth string")
    assert policy.conformal_calibration(a, t).first().mass == pytest.approx(0.8)
    assert policy.conformal_calibration(a.where("question = 0"), t.where("question = 0")).first().mass == 1.0


def test_invalid_distributions(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, "a", -1.0), (2, "b", 2.0), (3, "a", 0.5), (3, "b", 0.5), (4, "a", 0.0)], "question long, option string, p double")
    assert {r.question: r.valid for r in policy.valid_distributions(df).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_fusion(spark):
    df = spark.createDataFrame([(0, "x", "a", 1), (0, "x", "a", 2), (0, "x", "b", 2), (0, "y", "b", 1), (0, "y", "c", 2)], "all int, source string, ref string, rank int")
    got = {r.ref: r.score for r in retrieval.fuse(df, ["all"], "ref").collect()}
    assert got["a"] == pytest.approx(1 / 61, abs=1e-8) and got["b"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_mmr_is_diverse(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 1, ["alpha", "target"]), (0, 2, 0.98, 2, ["alpha", "target"]), (0, 3, 0.95, 3, ["beta", "other"])], "q int, ref int, score double, step int, ts array<string>")
    assert [r.ref for r in retrieval.mmr(df, "q", "ref", "score", "ts", "step", 2).orderBy("rank").collect()] == [1, 3]


def test_tournament_and_budget(spark):
    c = spark.createDataFrame([(1, i, float(i)) for i in range(90)], "g int, item int, s double")
    assert search.tournament(c, "g", "item", "s").count() <= 8
    calls = spark.createDataFrame([(1, i, 10) for i in range(5)], "c int, i int, tok long")
    r = search.budget_stop(calls, "c", ["i"], "tok", 10, 25).first()
    assert (r.stop_at, r.reason) == (3, "input_token_budget")



def test_tournament_reads_its_candidates_once(spark):
    """Against a plain loop; the plan holds the candidates once, where every round doubled it."""
    sizes = {None: 9, "a": 700, "b": 61, "c": 8, "d": 1}
    rows = [(g, i * 3, (i * 7919 + 5) % 101 if i % 17 else None) for g, n in sizes.items() for i in range(n)]
    out = search.tournament(spark.createDataFrame(rows, "g string, item long, s long").repartition(3), "g", "item", "s")
    want = []
    for g in sizes:
        live = [r[1:] for r in rows if r[0] == g]
        while len(live) > 8:
            groups = [live[k : k + 8] for k in range(0, len(live), 8)]
            live = sorted(x for part in groups for x in sorted(part, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:3])
        want += [(g, *x) for x in live]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert out._jdf.queryExecution().analyzed().collectLeaves().size() <= 3


def test_missing_scores_wrong(spark):
    g = spark.createDataFrame([(0, "a", 3, 0, "Planner (-> Worker)"), (1, "a", 3, 0, "Planner"), (2, "b", 3, 0, "Planner")], "conv_id int, source string, n_steps int, mistake_step int, mistake_agent string")
    p = spark.createDataFrame([(0, 2, "  PLANNER (-> X) "), (2, 0, "w")], "conv_id int, predicted_step int, predicted_role string")
    s = metrics.score_rows(g, p)
    assert metrics.weighted_mae(s, "source").first().weighted_mae == pytest.approx(4 / 3, abs=1e-6)
    assert metrics.metrics(s).first().exact == pytest.approx(1 / 3, abs=1e-6)


def test_case_scan(spark, tmp_path):
    import hashlib

    (tmp_path / "src").mkdir()
    rows = []
    for i, h in enumerate([[{"step": 0, "name": "A", "role": "", "content": "x"}], [{"step": 1, "name": "A", "role": "", "content": "x"}], []]):
        text = json.dumps({"question_ID": str(i), "mistake_agent": "A", "mistake_step": 0, "history": h})
        (tmp_path / "src" / f"{i}.json").write_text(text)
        rows.append((f"src/{i}.json", str(i), hashlib.sha256(text.encode()).hexdigest() if i < 2 else "bad"))
    m = spark.createDataFrame(rows, "path string, question_ID string, sha256 string")
    good, bad = io.read_cases(spark, str(tmp_path), m.drop("question_ID"))
    assert [r.question_ID for r in io.explode_steps(good).collect()] == ["0"]
    assert {r.path: r.reason for r in bad.collect()} == {"src/1.json": "steps", "src/2.json": "digest"}


def test_freeze_config(spark, tmp_path):
    path = str(tmp_path / "runs")
    io.freeze_config(spark, path, "r", {"a": 1})
    assert io.freeze_config(spark, path, "r", {"a": 1})
    with pytest.raises(ValueError):
        io.freeze_config(spark, path, "r", {"a": 2})


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, True, (5,))], "id int, ok boolean, prediction struct<step:int>")
    io.write_csv(df, str(tmp_path / "o"), ["id", "ok", "step", "none"])
    assert [tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "o")).collect()] == [("1", "True", "5", None)]


def test_whole_rankings_are_fused(spark):
    rankings = {"x": list(range(30)), "y": list(range(30)), "z": list(range(29, -1, -1))}  # x and y are one ranking
    df = spark.createDataFrame([(q, r, k) for q, refs in rankings.items() for k, r in enumerate(refs, 1)], "q string, ref int, rank int")
    want = {r: round(sum(1 / (60 + 1 + o.index(r)) for o in (rankings["x"], rankings["z"])), 9) for r in range(30)}
    got = retrieval.fuse_whole(df, df, "ref", "q").orderBy("rank").collect()
    assert [r.ref for r in got] == sorted(want, key=lambda r: (-want[r], r)) and [r.rank for r in got] == list(range(1, 31))
    assert {r.ref: r.score for r in got} == pytest.approx(want, abs=1e-8)
    assert {r.score for r in retrieval.fuse_whole(df.limit(0), df, "ref", "q").collect()} == {1.0}


def greedy(rows, k):
    """The reference's choice over every row (ref, score, same, terms)."""
    left, chosen, top = list(rows), [], max(r[1] for r in rows)
    while left and len(chosen) < k:
        like = lambda r: max((1.0 if c[2] == r[2] else len(set(r[3]) & set(c[3])) / max(len(set(r[3]) | set(c[3])), 1) for c in chosen), default=0)  # noqa: B023, E731
        best = min(left, key=lambda r: (-(0.7 * r[1] / top - 0.3 * like(r)), -r[1], r[0]))  # noqa: B023
        left.remove(best)
        chosen.append(best)
    return [r[0] for r in chosen]


def test_mmr_takes_all_candidates(spark):
    import random

    rng = random.Random(4)
    rows = [(i, round(rng.uniform(1, 9), 3), rng.randint(0, 4), rng.sample("abcdefgh", 3)) for i in range(60)]
    df = spark.createDataFrame([(0, *r) for r in rows] + [(1, *r) for r in rows[:3]], "q int, ref int, score double, step int, ts array<string>")
    got = {q: [r.ref for r in retrieval.mmr(df, "q", "ref", "score", "ts", "step", 5).where(f"q = {q}").orderBy("rank").collect()] for q in (0, 1)}
    assert got == {0: greedy(rows, 5), 1: greedy(rows[:3], 5)}
    ranked = df.withColumn("rank", F.expr("row_number() over (partition by q order by score desc, ref)"))
    few = retrieval.contenders(ranked, "q", "score", 5)
    assert few.count() < df.count()
    assert [r.ref for r in retrieval.mmr(few, "q", "ref", "score", "ts", "step", 5).where("q = 0").orderBy("rank").collect()] == greedy(rows, 5)


def test_mmr_select_reaches_below_rank_20(spark, tmp_path):
    from logloom.plans import catalogue

    docs = [(i, "alpha beta", "hot") for i in range(30)] + [(30, "alpha beta alpha beta gamma", "other")] + [(40 + i, "omega psi", "none") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "alpha beta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.doc_id for r in catalogue.mmr_select(spark, str(tmp_path)).orderBy("rank").collect()][:2] == [0, 30]


def test_chinese_has_tokens_and_ranks(spark):
    from logloom.functions.text import evidence_terms, tokens

    df = spark.createDataFrame([(1, "验证 Run a1 修复失败 中 x"), (2, "plain words here"), (3, None)], "doc_id int, text string")
    assert {r.doc_id: r.t for r in df.select("doc_id", tokens(F.col("text")).alias("t")).collect()} == {1: ["run", "a1", "验证", "修复", "复失", "失败", "中"], 2: ["plain", "words", "here"], 3: []}
    asked = spark.createDataFrame([(7, "测试失败")], "item_id int, query_text string")
    assert [(r.item_id, r.doc_id) for r in retrieval.bm25(df, asked, "doc_id", "text", "item_id", "query_text").collect()] == [(7, 1)]
    assert spark.createDataFrame([("The plan and that_x",)], "s string").select(evidence_terms(F.col("s")).alias("t")).first().t == ["plan", "that_x"]


def test_evidence_has_directions_and_bonuses(spark):
    rows = [(1, 0, "Boss (-> Worker)", "a", 0, "nothing shared"), (1, 1, "Other", "b", 0, "this alpha beta"), (1, 2, "Worker", "c", 0, "this alpha beta"), (1, 3, "Checker", "d", 0, "已修复"), (1, 4, "Other", "e", 0, "gamma this with")]
    spans = spark.createDataFrame(rows, "conv_id int, step int, name string, ref string, start_byte int, text string")
    asked = spark.createDataFrame([(1, 2, k) for k in ("upstream", "repair", "challenge")], "conv_id int, step int, kind string")
    seen = spark.createDataFrame([(1, 2, "challenge", "b")], "conv_id int, step int, kind string, ref string")
    out = {}
    for r in retrieval.evidence(spans, asked, seen=seen).orderBy("kind", "rank").collect():
        out.setdefault(r.kind, []).append((r.ref, r.score))
    alpha = round(2 * __import__("math").log(1 + 5 / 2), 6)
    assert out == {"upstream": [("a", 12.0), ("b", alpha)], "repair": [("d", 3.0), ("e", 0.0)], "challenge": [("d", 3.0), ("a", 0.0), ("e", 0.0)]}
