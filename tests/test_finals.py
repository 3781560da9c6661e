"""Final decisions by a table of answers; the queries against their SQL."""

import os

import pytest

from logloom.operators import finals
from logloom.plans import catalogue
from logloom.plans import finals as plans

TABLES = "/root/testdata/sf0.001"
ASKED = "conv_id int, n_candidates int, root int, root_p double, verified boolean, role string, role_p double, role_cited boolean, support string, support_p double, origin string, origin_p double, outcome string, outcome_p double, cited_step int, attempted array<string>, relations boolean"
ALL = ["upstream", "repair", "challenge"]
#: candidates, root, its p, checked; role p, cited; support, origin, outcome with p; cited step, attempted, relations; then both verdicts.
CASES = [
    ((0, None, None, True), (0.9, True), ("supported", 0.9), ("local", 0.9), ("persists", 0.9), 5, ALL, True, "no_inspected_viable_candidate", "no_inspected_viable_candidate"),
    ((None, None, None, None), (None, None), (None, None), (None, None), (None, None), None, None, None, "no_inspected_viable_candidate", "no_inspected_viable_candidate"),
    ((2, None, 0.9, True), (0.9, True), ("supported", 0.9), ("local", 0.9), ("persists", 0.9), 5, ALL, True, "no_final_candidate", "no_final_candidate"),
    ((2, 5, 0.9, False), (0.9, True), ("refuted", 0.9), ("no_violation", 0.9), ("repaired", 0.9), 5, ALL, True, "verification_budget_exhausted", "verification_budget_exhausted"),
    ((2, 5, 0.9, True), (0.9, True), ("refuted", 0.9), ("no_violation", 0.9), ("persists", 0.9), 5, ALL, True, "independent_evidence_refuted", "independent_evidence_refuted"),
    ((2, 5, 0.9, True), (0.9, True), ("refuted", 0.7), ("no_violation", 0.7), ("unlinked", 0.8), 5, ALL, True, "point_prediction_unverified", "independent_evidence_refuted"),
    ((2, 5, 0.9, True), (0.9, True), ("supported", 0.8), ("local", 0.8), ("persists", 0.8), 5, ALL, True, "retrieved_evidence_checked", "fresh_origin_and_outcome_checked"),
    ((2, 5, 0.9, True), (0.7, True), ("supported", 0.8), ("local", 0.8), ("persists", 0.8), 5, ALL[:2], True, "point_prediction_unverified", "fresh_origin_and_outcome_checked"),
    ((2, 5, 0.9, True), (0.9, False), ("supported", 0.8), ("local", 0.8), ("unknown", 0.8), 5, ALL, False, "point_prediction_unverified", "point_prediction_unverified"),
    ((2, 5, 0.7, True), (0.9, True), ("supported", 0.9), ("local", 0.9), ("persists", 0.9), 5, ALL, True, "point_prediction_unverified", "point_prediction_unverified"),
    ((2, 5, 0.9, True), (0.9, True), ("supported", 0.9), ("local", 0.9), ("persists", 0.9), 4, ALL, True, "point_prediction_unverified", "point_prediction_unverified"),
]


def test_decisions_by_the_table(spark):
    rows = [(k, n, root, p, checked, "planner", role_p, role_cited, *support, *origin, *outcome, cited, tried, relations) for k, ((n, root, p, checked), (role_p, role_cited), support, origin, outcome, cited, tried, relations, _, _) in enumerate(CASES)]
    asked = spark.createDataFrame(rows, ASKED)
    for at, verdict in ((8, finals.joint_verdict(0.8)), (9, finals.factored_verdict(0.8))):
        for r in finals.decide(asked, verdict).collect():
            (_, root, _, checked), (role_p, cited), reason = CASES[r.conv_id][0], CASES[r.conv_id][1], CASES[r.conv_id][at]
            status = "supported" if reason.endswith("_checked") else "best_effort" if reason in ("point_prediction_unverified", "verification_budget_exhausted") else "abstained"
            point, sure = root if status != "abstained" else None, status == "supported"
            whose = "planner" if sure and role_p >= 0.8 and cited else None
            assert tuple(r)[1:] == (point, "planner" if point is not None and checked else None, point if sure else None, whose, status, reason), r


def test_the_widest_excerpts_that_fit(spark):
    rows = [(1, 10), (1, 20), (2, 5000), (2, 5000), (3, 9999), (4, 10**9), (4, 10**9), (4, 10**9)]
    got = finals.ladder(spark.createDataFrame(rows, "c int, n long"), "c", "n", 50, 2000).collect()
    assert {r.c: (r.n_candidates, r.width) for r in got} == {1: (2, 1800), 2: (2, 900), 3: (1, 1800), 4: (3, 300)}


@pytest.mark.parametrize("name", [n for n, f in catalogue.queries().items() if f.__module__ == plans.__name__])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f.split('.')[0]} as select * from '{TABLES}/{f}'")
    got, told = catalogue.queries()[name](spark, TABLES), con.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in told.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(told.fetchall(), key=str)
