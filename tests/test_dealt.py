"""What every round reads lies where it is: no round shuffles the facts of a log."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions.workers import dealt_once
from logloom.operators import clients, postings, retrieval, segment, spans
from logloom.plans.evidence import SIGNALS


@pytest.fixture
def plain(spark):
    """Large tables' plans on small ones."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def moved(df, column):
    """How many scans of the column are shuffled before they meet anything, and how many scans there are."""
    above, out = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = re.search(r"[A-Za-z(*]", line).start() if re.search(r"[A-Za-z(*]", line) else 0
        above = [x for x in above if x[0] < at]
        if "FileScan" in line and f"{column}#" in line:
            names = [x[1] for x in above]
            joins = [k for k, x in enumerate(names) if "Join" in x]
            out.append(any("Exchange" in x for x in names[joins[-1] if joins else 0 :]))
        above.append((at, line))
    return sum(out), len(out)


def test_a_client_moves_no_facts(spark, plain):
    rows = [(c, k, "user", "assistant", f"error in part {k % 3} of task {c}, fixed and tested") for c in range(20) for k in range(6)]
    steps = spark.createDataFrame(rows, "conv_id long, step int, role string, name string, content string")
    facts = clients.facts(steps, SIGNALS)
    asked = steps.where("step = conv_id % 6").select("conv_id", "step", F.when(F.col("conv_id") % 4 == 0, "inspect").when(F.col("conv_id") % 4 == 1, "upstream").when(F.col("conv_id") % 4 == 2, "repair").otherwise("challenge").alias("action"), F.expr("cast(map() as map<string,int>)").alias("pages"), F.lit(1).alias("unread"))
    told = clients.lexical(dealt_once(facts, ["conv_id"]))(asked)
    shuffled, scans = moved(told, "ts")
    assert scans >= 2 and shuffled == 0
    want = clients.lexical(facts)(asked)
    assert sorted(map(str, told.collect())) == sorted(map(str, want.collect())) and told.count() == 20


def test_dealt_rows_are_whole(spark, plain):
    df = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(100)], "g long, v long")
    dealt = dealt_once(df, ["g"])
    assert sorted(map(str, dealt.collect())) == sorted(map(str, df.collect()))
    assert not spark.catalog.listTables()
    assert "Exchange" not in dealt.groupBy("g").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()


def test_a_frequent_term_s_rows_never_meet(spark, plain, monkeypatch):
    """No shuffle by term lies above a document's texts: rows of a term in every document would all meet in one task."""
    docs = spark.createDataFrame([(k % 97, f"alpha beta{k % 5} gamma{k}") for k in range(100)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Alpha beta1 beta1"), (2, "gamma7 delta"), (3, "")], "item_id long, asked string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    out = retrieval.overlap_idf(docs, asked, "doc_id", "text", "item_id", "asked")
    assert "hashpartitioning(term" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "PAIRS", 30)
    assert "10 out of 10" in retrieval.overlap_idf(docs, asked, "doc_id", "text", "item_id", "asked")._jdf.queryExecution().executedPlan().toString()
    got = {(r.item_id, r.doc_id): (r.score, r["rank"]) for r in out.collect()}
    idf = {"alpha": math.log(2), "beta1": math.log(6), "gamma7": math.log(101)}
    want = {}
    for k in range(100):
        for item, words in ((1, ("alpha", "beta1")), (2, ("gamma7",))):
            held = [w for w in words if w in ("alpha", f"beta{k % 5}", f"gamma{k}")]
            if held:
                want[item, k % 97] = want.get((item, k % 97), 0) + sum(idf[w] for w in held)
    assert {k: v[0] for k, v in got.items()} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    assert [k for k, v in got.items() if v[1] == 1] == [k for k, v in got.items() if (-v[0], k[1]) == min((-w[0], m[1]) for m, w in got.items() if m[0] == k[0])]


def test_workers_give_back_ends_not_pieces(spark):
    """Pieces of a batch were held in a worker as text; now it gives back numbers, and the pieces are the same."""
    texts = [None, "", "a" * 7, "äöü€" * 9, "x\U0001f600" * 5, "日本語テキスト" * 4, "\x00b\n" * 6]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for budget in (1, 2, 5, 8, 2200):
        out = segment.utf8_pieces(df, "text", budget)
        got = sorted((r.k, r.part, r.start_byte, r.end_byte, r.piece) for r in out.collect())
        assert got == [(k, *p) for k, t in enumerate(texts) for p in segment.split_utf8(t or "", budget)]
        assert all(r.sha256 == hashlib.sha256(r.piece.encode()).hexdigest() for r in out.collect())
    udf = re.search(r"ArrowEvalPython \[(\w+)\(", out._jdf.queryExecution().executedPlan().toString()).group(1)
    assert udf == "ends"


def test_only_asked_words_become_rows(spark, plain):
    """A log dealt out by case isn't moved for its rarest words, though rows of a step repeat; every token was a row that was moved."""
    rows = [(c, k, f"w{(k * 5 + c) % 7} common w{k % 4} w{k % 4} own{k}") for c in range(6) for k in range(9)] + [(2, 3, "w6 common"), (2, 3, "zz")]
    steps = spark.createDataFrame(rows, "c long, s int, t string")
    asked = spark.createDataFrame([(c, w) for c in range(5) for w in ("common", "w1", "w2", "w6", "none")], "c long, term string")
    out = spans.rarest_term(dealt_once(steps, ["c"]), dealt_once(asked, ["c"]), "c", "s", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    held = {}
    for c, s, t in rows:
        for pos, w in enumerate(t.split()):
            if c < 5 and w in ("common", "w1", "w2", "w6", "none"):
                held[c, s, w] = min(held.get((c, s, w), pos), pos)
    want = {}
    for (c, s, w), pos in held.items():
        df = len({k for k in held if k[0] == c and k[2] == w})
        want[c, s] = min(want.get((c, s), (df, pos, w)), (df, pos, w))
    assert {(r.c, r.s): r.term for r in out.collect()} == {k: v[2] for k, v in want.items()}


def test_two_pages_read_the_postings_once(spark, monkeypatch):
    """Near copies lead a query through all pages; each page ranked all postings anew."""
    docs = spark.createDataFrame([(k, "alpha beta " + "same words here " * 3, "s") for k in range(90)] + [(90 + k, f"alpha other{k} text{k}", f"t{k}") for k in range(5)], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "other3")], "item_id long, term string")
    reached = []
    ranked = postings.Postings.ranked
    monkeypatch.setattr(postings.Postings, "ranked", lambda self, a, q, k: reached.append(k) or ranked(self, a, q, k))
    with postings.Postings(docs, "doc_id", "text", asked.select("term")) as index:
        choose = lambda first: sorted(map(tuple, postings.diverse_refs(index, docs, asked, "item_id", "text", "source", 3, first=first, most=128).collect()))
        got, want = choose(2), choose(128)
    assert got == want and len(got) == 4
    assert reached == [12, 129, 129]
