"""Joins over ordered logs: as-of hand-offs, neighbours, resumption and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_role, recipient


def handoff_asof(steps: DataFrame, case: str = "conv_id", step: str = "step", name: str = "name") -> DataFrame:
    """For each step the latest earlier hand-off that addresses its role, else the latest earlier hand-off.

    Two running maxima: one over all hand-offs of the case, one over those that address a role, joined to its steps in one
    partitioning by (case, role) of events; nothing is joined step by step.
    """
    base = steps.select("*", normalize_role(F.col(name)).alias("__role"), recipient(F.col(name)).alias("__to"))
    before = Window.partitionBy(case).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    latest = base.withColumn("__latest", F.max(F.when(F.col("__to") != "", F.col(step))).over(before))
    asks = latest.select(case, F.col(step).alias("__at"), F.col("__role").alias("__key"), F.lit(None).cast("long").alias("__sent"), F.struct(*[F.col(c) for c in latest.columns]).alias("__row"))
    sends = base.where("__to <> ''").select(case, F.col(step).alias("__at"), F.col("__to").alias("__key"), F.col(step).cast("long").alias("__sent"), F.lit(None).cast(asks.schema["__row"].dataType).alias("__row"))
    run = Window.partitionBy(case, "__key").orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    met = asks.unionByName(sends).withColumn("__addressed", F.max("__sent").over(run)).where("__row is not null")
    return met.select("__row.*", "__addressed").select(*steps.columns, F.coalesce("__addressed", "__latest").cast("long").alias("handoff_step"), F.col("__addressed").isNotNull().alias("addressed"))


def neighbours(steps: DataFrame, case: str = "conv_id", step: str = "step") -> DataFrame:
    w = Window.partitionBy(case).orderBy(step)
    return steps.withColumn("previous_step", F.lag(step).over(w)).withColumn("next_step", F.lead(step).over(w))


def overlap_context(starts: DataFrame, steps: DataFrame, case: str, start: str, step: str, back: int = 3) -> DataFrame:
    """The up to `back` steps before each start: an equi-join on the case, after a start is spread to the steps it asks for."""
    asked = starts.select(case, start, F.explode(F.sequence(F.col(start) - back, F.col(start) - 1)).alias(step))
    return asked.join(steps, [case, step])


def resume_todo(todo: DataFrame, done: DataFrame, key: str, digest: str | None = None) -> DataFrame:
    """What is left to do: rows without a finished one of the same key (and digest)."""
    return todo.join(done, [key] + ([digest] if digest else []), "left_anti")


def subset_mismatch(subset: DataFrame, full: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of a subset that the full table lacks or holds with another digest."""
    return subset.join(full, [key, digest], "left_anti")


def trace(edges: DataFrame, starts: DataFrame, case: str, step: str, upstream: str, depth: int = 2) -> DataFrame:
    """Steps reached from starts by following edges at most depth hops, with the least number of hops."""
    level = starts.select(case, step, F.col(step).alias("reached"), F.lit(0).alias("hops"))
    out = level
    for k in range(1, depth + 1):
        e = edges.select(case, F.col(step).alias("reached"), F.col(upstream).alias("__up")).where("__up is not null")
        level = level.join(e, [case, "reached"]).select(case, step, F.col("__up").alias("reached"), F.lit(k).alias("hops"))
        out = out.unionByName(level)
    return out.groupBy(case, step, "reached").agg(F.min("hops").alias("hops"))
