"""Trees, previews and search orders against plain recursion; the queries against their SQL."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import choice, directory
from logloom.plans import attribution, catalogue, directories

TABLES = "/root/testdata/sf0.001"
NAMES = [name for name, f in catalogue.queries().items() if f.__module__ in (directories.__name__, attribution.__name__) and name in catalogue.oracle_sql()]


def tree_of(s, e, fanout):
    """(s, e, children), by the definition: as many leaves for each child as the fan-out asks for, the last one what is left."""
    width = math.ceil((e - s) / fanout)
    return (s, e, [tree_of(x, min(x + width, e), fanout) for x in range(s, e, width)] if e - s > 1 else [])


def flat(node, above=()):
    yield node[:2], above + (node[:2],)
    for child in node[2]:
        yield from flat(child, above + (node[:2],))


@pytest.mark.parametrize("fanout", [2, 3, 6])
def test_nodes_are_those_of_the_definition(spark, fanout):
    sizes = {None: 5, 1: 1, 2: 2, 3: 37, 4: 216, 5: 217}
    leaves = spark.createDataFrame([(c, k, n) for c, n in sizes.items() for k in range(n)], "c long, leaf long, n long")
    got = {(r.c, r.s, r.e): tuple((x.s, x.e) for x in r.up) for r in directory.nodes(leaves, "c", "leaf", "n", fanout).collect()}
    assert got == {(c, *node): up for c, n in sizes.items() for node, up in flat(tree_of(0, n, fanout))}


def read_order(node, p):
    """Leaves as a depth-first search reads them: (leaf, questions asked, regions waiting), likelier children first."""
    out, asked = [], 0

    def visit(node, waiting):
        nonlocal asked
        if not node[2]:
            out.append((node[0], asked, waiting))
            return
        asked += 1
        order = sorted(node[2], key=lambda k: (-p.get(k[:2], 0.0), f"range_{k[0]}_{k[1]}"))
        for at, child in enumerate(order):
            visit(child, waiting + len(order) - 1 - at)

    visit(node, 0)
    return out


def test_visits_and_attempts_against_recursion(spark):
    rng, fanout = random.Random(9), 3
    sizes = {1: 1, 2: 2, 3: 40, 4: 82, None: 7}
    held = {(c, k): rng.randint(1, 4) for c, n in sizes.items() for k in range(n)}
    p = {c: {node: rng.choice([0.1, 0.25, 0.5]) for node, up in flat(tree_of(0, n, fanout)) if len(up) > 1} for c, n in sizes.items()}
    leaves = spark.createDataFrame([(c, k, sizes[c]) for c, k in held], "c long, leaf long, n long")
    tree = directory.nodes(leaves, "c", "leaf", "n", fanout)
    answers = spark.createDataFrame([(c, *node, x) for c, t in p.items() for node, x in t.items()], "c long, s long, e long, p double")
    items = spark.createDataFrame([(c, k, n) for (c, k), n in held.items()], "c long, segment long, n_items long")
    order = directory.visits(tree, answers, "c", items)
    got = {}
    for r in order.collect():
        got.setdefault(r.c, []).append((r.visit, r.segment, r.routed, r.pending, r.items_before))
    for c, n in sizes.items():
        want, before = [], 0
        for visit, (leaf, asked, waiting) in enumerate(read_order(tree_of(0, n, fanout), p[c])):
            want.append((visit, leaf, asked, waiting, before))
            before += held[c, leaf]
        assert sorted(got[c]) == want, c
    leads = spark.createDataFrame([(c, k, place, n, f"{c}-{k}-{place}") for (c, k), n in held.items() for place in range(n)], "c long, segment long, place int, n_here int, lead string")
    totals = spark.createDataFrame([(c, n, sum(held[c, k] for k in range(n))) for c, n in sizes.items()], "c long, n_segments long, n_items long")
    taken = {}
    for r in directory.attempts(leads, order, totals, "c").collect():
        taken.setdefault(r.c, []).append((r.attempt, r.lead))
    for c, n in sizes.items():
        unread, stack, want = [leaf for leaf, _, _ in read_order(tree_of(0, n, fanout), p[c])], [], []
        while unread or stack:
            if unread:  # one more segment is read before the next lead is taken
                leaf = unread.pop(0)
                stack = [f"{c}-{leaf}-{place}" for place in range(held[c, leaf])] + stack
            want.append(stack.pop(0))
        assert [lead for _, lead in sorted(taken[c])] == want and sorted(a for a, _ in taken[c]) == list(range(len(want)))


def test_rolled_up_regions(spark):
    rng, fanout, n = random.Random(3), 2, 9
    rows = [(1, k, k // 3, n, k * 2, f"r{k}", rng.randint(0, 2), rng.randint(0, 3), rng.random() < 0.3) for k in range(25)]
    items = spark.createDataFrame(rows, "c long, idx long, seg long, n long, step long, ref string, hits long, overlap long, tag boolean")
    got = {(r.s, r.e): r for r in directory.rolled_up(items, "c", "seg", "n", "idx", "step", "ref", "hits", "overlap", ["tag"], fanout).collect()}
    assert set(got) == {node for node, _ in flat(tree_of(0, n, fanout))}
    for (s, e), r in got.items():
        own = [x for x in rows if s <= x[2] < e]
        best = min(own, key=lambda x: (-x[6], -x[7], x[4], x[5]))
        assert (r.n_refs, r.first_step, r.last_step, r.best.ref, r.tag, r.middle_idx) == (len(own), own[0][4], own[-1][4], best[5], any(x[8] for x in own), own[len(own) // 2][1])


def test_distribution_sums_to_one_and_breaks_ties_by_name(spark):
    rows = [(q, o, s) for q, told in {"a": {"x": 1.0, "y": 1.0, "z": None}, "b": {"only": -3.0}, None: {"u": 800.0, "v": -800.0}}.items() for o, s in told.items()]
    got = choice.distribution(spark.createDataFrame(rows, "q string, o string, s double"), ["q"], "o", "s").collect()
    for q, best in (("a", "x"), ("b", "only"), (None, "u")):
        own = [r for r in got if r.q == q]
        assert {r.choice for r in own} == {best} and sum(r.p for r in own) == pytest.approx(1.0, abs=1e-8)
    e = math.e
    assert {r.o: r.p for r in got if r.q == "a"} == {"x": round(e / (2 * e + 1), 9), "y": round(e / (2 * e + 1), 9), "z": round(1 / (2 * e + 1), 9)}


@pytest.mark.parametrize("name", NAMES)
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


def test_empty_tree(spark):
    leaves = spark.createDataFrame([], "c long, leaf long, n long")
    assert directory.nodes(leaves, "c", "leaf", "n").isEmpty() and directory.nodes(leaves.withColumn("x", F.lit(1)), "c", "leaf", "n").columns == ["c", "s", "e", "depth", "n", "up"]
