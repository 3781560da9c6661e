"""Every query of the evidence module against its SQL on the smallest tables, and the faults that must be found."""

import os

import pytest

from logloom.operators import segment
from logloom.plans import catalogue, evidence

TABLES = "/root/testdata/sf0.001"
NAMES = [name for name, f in catalogue.queries().items() if f.__module__ == evidence.__name__]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"create view {f.split('.')[0]} as select * from '{TABLES}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, TABLES)
    told = duck.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in told.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(told.fetchall(), key=str)


def test_statuses_and_faults(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "tag int, digest string")
    cache = spark.createDataFrame([(1, "a"), (2, "x")], "tag int, digest string")
    assert {r.tag: r.status for r in evidence.cache_lookup(requests, cache, ["tag"], "digest").collect()} == {1: "hit", 2: "mismatch", 3: "miss"}
    rows = spark.createDataFrame([(200, ""), (402, ""), (400, "Out of credits"), (429, ""), (403, "no")], "status int, body string")
    assert [r[0] for r in rows.select(evidence.error_class(rows.status, rows.body)).collect()] == ["ok", "balance", "balance", "transient", "fatal"]


def test_clip_gives_both_ends_the_same_room():
    clipped = segment.clip_text("x" * 500, 200)
    head, tail = clipped.split(segment.MARK)
    assert len(head) == len(tail) == (200 - len(segment.MARK)) // 2


def test_settings_are_checked():
    from logloom.operators.settings import SearchSettings

    assert SearchSettings().checked() == SearchSettings()
    wrong = {
        "span_bytes": [0, -1, 2.5, True, float("nan"), None, "9"], "selection_mass": [0.0, 1.01, float("inf")], "decision_threshold": [-0.1], "diversity_percent": [101, 0], "directory_fanout": [1, 13],
        "segment_records": [251], "evidence_bytes": [5199], "reserve_calls": [1], "reserve_request_bytes": [123_999], "global_retrieval": [2, True, 0.0], "factored_verification": [-1], "max_hops": [0],
    }
    for name, values in wrong.items():
        for value in values:
            assert SearchSettings(**{name: value}).faults() == [name], (name, value)
    with pytest.raises(ValueError, match="max_calls, max_rounds"):
        SearchSettings(max_calls=0, max_rounds=-1).checked()
    assert SearchSettings(selection_mass=1, global_retrieval=0).faults() == []
