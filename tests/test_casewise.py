"""A search without budgets goes on to its end, and by case it is the search by rounds."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import casewise, clients, frontier
from logloom.plans import searches
from logloom.plans.evidence import SIGNALS

TEXTS = [
    "please fix the failed test of the parser", "error: the parser failed again", "the parser must pass, validation is required", "", "parser repaired, test verified",
    "wrote the report about cats " * 12, "exception in the report writer, missing cats", None, "corrected the writer, the report should pass now",
]
ROLES = ("user", "assistant", "system")


def conversations(spark, path, lengths, more=()):
    rows = [(c, t, ROLES[(c + t) % 3], TEXTS[(c * 5 + t * (1 + c % 4)) % len(TEXTS)]) for c, n in lengths.items() for t in range(n)]
    spark.createDataFrame([*rows, *more], "conv_id long, turn int, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path)


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    return sorted((k, plain(x)) for k, x in v.items()) if isinstance(v, dict) else v


def rows_of(frames):
    return [sorted(str(plain(r)) for r in f.collect()) for f in frames]


def by_case(**budgets):
    """frontier.search by case, under any budgets."""
    def search(found, cards, unread, client, cost, ledger=None, **given):
        most = {"rounds": 24, "max_calls": 64, "max_bytes": 1_600_000, "request_bytes": 62_000, **given, **budgets}
        return casewise.search(found, cards, unread, client, cost, "conv_id", sure=frontier.SURE, **most)

    return search


def test_finalised_cases_search_to_their_end(spark, tmp_path, monkeypatch):
    d, seen, decided = conversations(spark, tmp_path, {c: 2 + c % 11 for c in range(-3, 24)}), [], searches._decided
    monkeypatch.setattr(searches, "_decided", lambda nodes, cases: seen.append((nodes, cases)) or decided(nodes, cases))
    got = searches.finalised_cases(spark, d).collect()
    (nodes, cases), steps = seen[0], {c: 2 + c % 11 for c in range(-3, 24)}
    ended = {r.conv_id: r for r in cases.collect()}
    assert set(ended) == {r.conv_id for r in got} == set(steps) and len(got) == len(steps)
    own = {}
    for n in nodes.collect():
        own.setdefault(n.conv_id, {})[n.step] = n
    for c, n_steps in steps.items():  # nothing is left: every step is a node, and all of one that isn't sidelined is asked
        assert ended[c].reason == "frontier_exhausted" and set(own[c]) == set(range(n_steps))
        assert all(set(n.done) == {"inspect", *frontier.CHECKS} for n in own[c].values() if n.status != "sidelined")
    assert max(r.acted for r in ended.values()) > 24
    assert any(r.decision_status == "supported" for r in got)
    assert all(r.decision_reason != "incomplete_evidence_checks" for r in got if r.conv_id % 7 != 2)


@pytest.mark.parametrize("budgets", [{"rounds": 9}, {"rounds": 6, "max_calls": 7, "max_bytes": 2 * 230 + 600, "request_bytes": 230}])
def test_a_case_plays_the_rounds_of_all(spark, tmp_path, monkeypatch, budgets):
    d = conversations(spark, tmp_path, {c: 1 + c % 10 for c in range(30)})
    most = {"max_bytes": 1_600_000, **budgets}
    want = rows_of(searches._search(spark, d, **most))
    monkeypatch.setattr(frontier, "search", by_case())
    got = rows_of(searches._search(spark, d, client=clients.lexical(clients.facts(searches._steps(spark, d), SIGNALS)), **most))
    assert got == want and len({r.split("'reason', '")[1].split("'")[0] for r in got[1]}) > 1


def test_without_budgets_both_end_alike(spark, tmp_path):
    """A client that doesn't answer by case is asked by rounds, until no case is left."""
    d, calls = conversations(spark, tmp_path, {0: 1, 3: 2, 4: 2, 6: 3}), []
    by_rounds = searches._search(spark, d, client=searches._client(spark, d, calls), **searches.ENDLESS)
    assert rows_of(by_rounds) == rows_of(searches._searched(spark, d)) and len(calls) > 8


def test_repeated_and_null_keys(spark, tmp_path):
    """A step that comes twice is one, a null case meets no step, and a null step can't be asked."""
    (tmp_path / "once").mkdir()
    (tmp_path / "twice").mkdir()
    lengths = {c: 3 + c % 7 for c in range(12)}
    long = "the longest text of all " * 40
    odd = [(None, 0, "user", "error"), (None, 1, "user", "fixed it"), (50, None, "user", long), (50, 1, "user", "error")]
    once = conversations(spark, tmp_path / "once", lengths, odd)
    spark.read.parquet(f"{once}/conversations.parquet").unionByName(spark.read.parquet(f"{once}/conversations.parquet").where("turn % 2 = 1")).write.parquet(str(tmp_path / "twice" / "conversations.parquet"))
    want, got = (rows_of(searches._searched(spark, d)) for d in (once, str(tmp_path / "twice")))
    assert got == want
    ended = {r.conv_id: r.reason for r in searches._searched(spark, once)[1].collect()}
    assert ended[None] == "frontier_exhausted" and ended[50] == "no_answer"


def test_a_log_ranks_its_pages_as_packets_do(spark, monkeypatch):
    """Page by page, also when what was ranked was forgotten in between."""
    monkeypatch.setattr(clients, "HELD", 10)
    texts = [f"{TEXTS[t % len(TEXTS)] or ''} part {t % 4}" for t in range(15)]
    names = ["user (-> assistant)", "assistant", "system (-> user)"]
    steps = spark.createDataFrame([(1, 2 * t, names[t % 3], x) for t, x in enumerate(texts)], "conv_id long, step int, name string, content string")
    known = clients.facts(steps, SIGNALS)
    log = clients.Log([r.asDict() for r in known.drop("conv_id").collect()], 2)
    pages = spark.createDataFrame([(1, 2 * t, a, p) for t in range(15) for a in frontier.CHECKS for p in (0, 1, 6, 7)], "conv_id long, step int, action string, page int")
    asked = pages.select("conv_id", "step", "action", F.create_map("action", "page").alias("pages"), F.lit(1).alias("unread"), "page")
    for page in (0, 1, 6, 7):
        for r in clients.lexical(known, 2)(asked.where(f"page = {page}")).collect():
            want = {k: r[k] for k in ("choice", "p", "need", "citation", "cited_step", "external_left", "read")} | {"causes": [(c.step, c.ref) for c in r.causes]}
            assert log.answer(r.step, r.action, page, 1) == want
    assert log.answer(3, "inspect", 0, 1) is None and log.answer(None, "repair", 0, 1) is None
