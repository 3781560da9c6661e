"""A balanced tree over a case's segments: previews of its regions, and the order in which a depth-first search reads them.

The tree is never walked level by level. A leaf's ancestors follow from its place by arithmetic, so what a region holds is one
aggregation of its leaves, each spread to its ancestors, and the place of a node in the search's order is one sum over its
ancestors of what their earlier siblings hold. Siblings, as many as the tree's fan-out, are all that ever meets in a window;
a case's size is the number of rows it has, not the size of a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import null_safe_join

NODE = "struct<s:bigint,e:bigint>"


def chain(leaf: Column, n: Column, fanout: int) -> Column:
    """The nodes (s, e) that hold a leaf of a tree over n leaves, from the root to the leaf itself."""
    most = F.ceil(F.ln(n.cast("double")) / math.log(fanout)).cast("int") + 2
    root = F.struct(F.lit(0).cast("bigint").alias("s"), n.cast("bigint").alias("e"))

    def down(path: Column, _: Column) -> Column:
        last = F.element_at(path, -1)
        width = F.floor((last["e"] - last["s"] + (fanout - 1)) / fanout)
        s = last["s"] + F.floor((leaf - last["s"]) / width) * width
        child = F.struct(s.cast("bigint").alias("s"), F.least(s + width, last["e"]).cast("bigint").alias("e"))
        return F.when(last["e"] - last["s"] > 1, F.concat(path, F.array(child))).otherwise(path)

    return F.aggregate(F.sequence(F.lit(1), most), F.array(root).cast(f"array<{NODE}>"), down)


def nodes(leaves: DataFrame, case: str, leaf: str, n: str, fanout: int = 6) -> DataFrame:
    """(case, s, e, depth, n, up) of every node, given each leaf once: a node comes from its first leaf. `up` holds its ancestors, itself last."""
    path = leaves.select(case, F.col(leaf).cast("bigint").alias("__leaf"), F.col(n).cast("bigint").alias("n")).withColumn("__path", chain(F.col("__leaf"), F.col("n"), fanout))
    each = path.select(case, "n", "__leaf", "__path", F.posexplode("__path").alias("depth", "node")).where("node.s = __leaf")
    return each.select(case, "node.s", "node.e", "depth", "n", F.slice("__path", F.lit(1), F.col("depth") + 1).alias("up"))


def rolled_up(items: DataFrame, case: str, seg: str, n: str, idx: str, step: str, ref: str, hits: str, overlap: str, tags: list[str], fanout: int = 6) -> DataFrame:
    """(case, s, e, n_refs, first_idx, middle_idx, first_step, last_step, best, the tags) of every region that holds an item.

    items: one row for each ref, in segments seg of n, idx counting a case's refs from 0. best is (hits, overlap, step, ref, idx) of the
    ref with the most hits, then the most overlap, then the first. Leaves are summed up before they are spread to their ancestors.
    """
    rank = F.struct((-F.col(hits)).alias("h"), (-F.col(overlap)).alias("o"), F.col(step).alias("step"), F.col(ref).alias("ref"), F.col(idx).alias("idx"))
    edge = F.struct(F.col(idx).alias("idx"), F.col(step).alias("step"))
    leaf = items.groupBy(case, F.col(seg).cast("bigint").alias("leaf"), F.col(n).cast("bigint").alias("n")).agg(F.count("*").alias("n_refs"), F.min(rank).alias("best"), F.min(edge).alias("first"), F.max(edge).alias("last"), *[F.bool_or(t).alias(t) for t in tags])
    spread = leaf.withColumn("node", F.explode(chain(F.col("leaf"), F.col("n"), fanout)))
    whole = spread.groupBy(case, "node.s", "node.e").agg(F.sum("n_refs").alias("n_refs"), F.min("best").alias("best"), F.min("first").alias("first"), F.max("last").alias("last"), *[F.bool_or(t).alias(t) for t in tags])
    best = F.struct((-F.col("best.h")).alias("hits"), (-F.col("best.o")).alias("overlap"), "best.step", "best.ref", "best.idx")
    return whole.select(case, "s", "e", "n_refs", F.col("first.idx").alias("first_idx"), (F.col("first.idx") + F.floor(F.col("n_refs") / 2)).alias("middle_idx"), F.col("first.step").alias("first_step"), F.col("last.step").alias("last_step"), best.alias("best"), *tags)


def region(s: Column, e: Column) -> Column:
    return F.concat_ws("_", F.lit("range"), s.cast("string"), e.cast("string"))


def visits(tree: DataFrame, answers: DataFrame, case: str, sizes: DataFrame) -> DataFrame:
    """(case, segment, visit, routed, pending, items_before) of every leaf, in the order of a depth-first search.

    tree: nodes(). answers: (case, s, e, p) of every node but the root, p being the answer of its parent's question; likelier children
    are read first, of equals the one whose name comes first. sizes: (case, segment, n_items). visit counts the leaves read before,
    routed the questions asked before, pending the regions that wait behind the leaf, items_before the items of the leaves read before.
    """
    above = F.explode(F.slice("up", F.lit(1), F.size("up") - 1)).alias("a")
    inner = tree.select(case, "s", "e", above).groupBy(case, F.col("a.s").alias("s"), F.col("a.e").alias("e")).agg(F.count("*").alias("below"))
    items = null_safe_join(tree.where("e - s = 1").select(case, "s", "up"), sizes.select(case, F.col("segment").alias("s"), "n_items"), [case, "s"], "left")
    held = items.select(case, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.explode("up").alias("a")).groupBy(case, F.col("a.s").alias("s"), F.col("a.e").alias("e")).agg(F.sum("n_items").alias("items"))
    sized = null_safe_join(null_safe_join(tree, inner, [case, "s", "e"], "left"), held, [case, "s", "e"], "left")
    child = sized.where("depth > 0").withColumn("parent", F.get("up", F.size("up") - 2))
    asked = null_safe_join(child, answers.select(case, "s", "e", "p"), [case, "s", "e"], "left")
    # siblings only: as many as the fan-out
    family = Window.partitionBy(case, "parent.s", "parent.e").orderBy(F.coalesce("p", F.lit(0.0)).desc(), region(F.col("s"), F.col("e")))
    earlier = family.rowsBetween(Window.unboundedPreceding, -1)
    placed = asked.select(
        case, "s", "e", F.coalesce(F.sum(F.coalesce("below", F.lit(0)) + 1).over(earlier), F.lit(0)).alias("nodes_before"),
        F.coalesce(F.sum(F.col("e") - F.col("s")).over(earlier), F.lit(0)).alias("leaves_before"), F.coalesce(F.sum("items").over(earlier), F.lit(0)).alias("items_before"),
        F.count("*").over(family.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    steps = tree.where("e - s = 1").select(case, F.col("s").alias("segment"), F.explode("up").alias("a")).select(case, "segment", F.col("a.s").alias("s"), F.col("a.e").alias("e"))
    sums = null_safe_join(steps, placed, [case, "s", "e"], "left").groupBy(case, "segment").agg(
        (F.coalesce(F.sum(F.col("nodes_before") + 1), F.lit(0))).alias("before"), F.coalesce(F.sum("leaves_before"), F.lit(0)).alias("visit"),
        F.coalesce(F.sum("later"), F.lit(0)).alias("pending"), F.coalesce(F.sum("items_before"), F.lit(0)).alias("items_before"),
    )
    return sums.select(case, "segment", "visit", (F.col("before") - F.col("visit")).alias("routed"), "pending", "items_before")


def attempts(leads: DataFrame, order: DataFrame, totals: DataFrame, case: str) -> DataFrame:
    """leads with attempt, from 0: when a search takes each of them up if none ends it.

    The search reads a segment, takes its best lead, and reads the next one before it goes on; new leads go before old ones. So the
    best lead of every segment comes first, in the order of visits, then the others of the segment read last, and so on
    backwards. leads: (case, segment, place from 0, ...), a step's refs all in one segment. order: visits(). totals: (case, n_segments, n_items).
    """
    met = null_safe_join(null_safe_join(leads, order.select(case, "segment", "visit", "items_before"), [case, "segment"]), totals, [case])
    size = F.col("n_items") - F.col("items_before")  # of this segment and of those read later
    later = size - F.col("n_here") - (F.col("n_segments") - F.col("visit") - 1)
    return met.withColumn("attempt", F.when(F.col("place") == 0, F.col("visit")).otherwise(F.col("n_segments") + later + F.col("place") - 1)).drop("visit", "items_before", "n_segments", "n_items", "n_here")
