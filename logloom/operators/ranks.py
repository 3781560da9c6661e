"""Exact ranks within few, large groups: no task ever holds a whole group.

Rows are counted by cell before any shuffle, offsets run over the cells, and only what lies in one cell is sorted together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import forget, kept_at, kept_once

CHUNK = 1 << 16


def band(value: Column) -> Column:
    """A number that never falls as the value grows: a quarter of a per cent of the value wide, some 16,000 on either side of 0."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.ln(1.0 + F.abs(v) * 1e9) * 400)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join where null meets null; right's keys are left out."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    joined = left.join(other, same, how)
    return joined.drop(*[f"__r_{c}" for c in on])


def grouped_rank(df: DataFrame, by: list[str], value: str, tie: str, out: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row within its group, by (value, tie); a null group is a group, values and ties aren't null.

    tie is a whole number. At most CHUNK rows of different ties meet in a task, and the offsets of one band's cells.
    """
    cell = [*by, "__band", value, "__chunk"]
    placed = df.withColumn("__band", band(F.col(value))).withColumn("__chunk", F.floor(F.col(tie) / CHUNK))
    cells = placed.groupBy(*cell).agg(F.count("*").alias("__c"))
    bands = cells.groupBy(*by, "__band").agg(F.sum("__c").alias("__m"))
    before = Window.partitionBy(*by).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(*by, "__band", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(*by, "__band").orderBy(value, "__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = null_safe_join(cells.withColumn("__inside", F.coalesce(F.sum("__c").over(inside), F.lit(0))), bands, [*by, "__band"])
    offsets = offsets.select(*cell, (F.col("__ahead") + F.col("__inside")).alias("__offset"))
    own = F.row_number().over(Window.partitionBy(*cell).orderBy(tie))
    ranked = null_safe_join(placed.withColumn("__own", own), offsets, cell)
    return ranked.select(*df.columns, (F.col("__offset") + F.col("__own")).alias(out))


def range_rank(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """df, kept, with the 1-based rank of each row within its group, by order, which must leave no ties; a null group is a group.

    Rows are dealt out by ranges of (by, order), so a group of any size is spread; a row's rank is its place among its partition's
    rows of the group, and the rows of the group in the partitions before. These are counted: a row for each group and partition.
    """
    keys = [*[F.col(c) for c in by], *order]
    told, path = kept_at(df)  # the ranges are found by a sample, which would compute df again
    placed = kept_once(told.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__pos", F.monotonically_increasing_id()))
    forget(df.sparkSession, path)
    at = placed.withColumn("__part", F.shiftright("__pos", 33))
    runs = at.groupBy(*by, "__part").agg(F.min("__pos").alias("__lo"), F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept_once(runs.select(*by, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1 - F.col("__lo")).alias("__offset")))
    return null_safe_join(at, offsets, [*by, "__part"]).select(*df.columns, (F.col("__pos") + F.col("__offset")).alias(out))


def value_at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, one column for each rank): the value at a 1-based rank of each group's non-null values; null beyond them.

    A rank is a function of the group's size n. Equal values are counted first; only the bands that hold an asked rank are sorted.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c")).withColumn("__band", band(F.col(value)))
    bands = counted.groupBy(*by, "__band").agg(F.sum("__c").alias("__m"))
    group = Window.partitionBy(*by)
    upto = bands.withColumn("__upto", F.sum("__m").over(group.orderBy("__band"))).withColumn("n", F.sum("__m").over(group))
    sizes = upto.groupBy(*by).agg(F.max("n").alias("n"))
    asked = F.lit(False)
    for rank in ranks.values():
        asked = asked | ((rank(F.col("n")) <= F.col("__upto")) & (rank(F.col("n")) > F.col("__upto") - F.col("__m")))
    held = null_safe_join(counted, upto.where(asked), [*by, "__band"])
    at = F.col("__upto") - F.col("__m") + F.sum("__c").over(Window.partitionBy(*by, "__band").orderBy(value))
    found = held.withColumn("__at", at).groupBy(*by).agg(*[F.min(F.when(F.col("__at") >= rank(F.col("n")), F.col(value))).alias(name) for name, rank in ranks.items()])
    return null_safe_join(sizes, found, by, "left")
