"""Lossless segmentation and byte-budget packing."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.workers import importable
from .ranks import null_safe_join

#: Fixed value: what stands for the part left out.
MARK = "\n[... excerpt omitted ...]\n"


def split_utf8(text: str, budget: int) -> list[tuple[int, int, int, str]]:
    """Parts of at most budget bytes that never break a code point (one wider than the budget stands alone)."""
    data, out, at = text.encode(), [], 0
    while at < len(data) or not out:
        end = min(at + budget, len(data))
        while end < len(data) and end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == at < len(data):
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append((len(out), at, end, data[at:end].decode()))
        at = end
        if not data:
            break
    return out


def utf8_pieces(df: DataFrame, text_col: str, budget: int) -> DataFrame:
    """Every row's pieces with byte offsets: part, start_byte, end_byte, piece, sha256.

    A worker reads one text at a time and gives back only where its pieces end; they are cut out of the text in the JVM.
    """
    importable(df.sparkSession)

    @F.arrow_udf("array<int>")
    def ends(texts: pa.Array) -> pa.Array:
        return pa.array(([end for _, _, end, _ in split_utf8(t.as_py() or "", budget)] for t in texts), pa.list_(pa.int32()))

    def cut(told: Column) -> Column:
        start = lambda k: F.coalesce(F.get(told["ends"], k - 1), F.lit(0))
        return F.transform(told["ends"], lambda end, k: F.struct(k.alias("part"), start(k).alias("start_byte"), end.alias("end_byte"), F.substring(told["raw"], start(k) + 1, end - start(k)).cast("string").alias("piece")))

    # the bytes are taken once for each text
    told = F.array(F.struct(ends(F.col(text_col)).alias("ends"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")))
    return df.select("*", F.explode(F.element_at(F.transform(told, cut), 1)).alias("__p")).select(*df.columns, "__p.*", F.sha2("__p.piece", 256).alias("sha256"))


def clip_text(text: str, budget: int) -> str:
    """Head and tail within a byte budget, a mark between."""
    data = text.encode()
    if len(data) <= budget:
        return text
    room = max(budget - len(MARK.encode()), 0)
    half = room // 2
    head, tail = data[:half], data[len(data) - half :] if half else b""
    return head.decode("utf-8", "ignore") + MARK + tail.decode("utf-8", "ignore")


def _continues(raw: Column, at: Column) -> Column:
    """Whether the byte at a 1-based place continues a code point."""
    return F.hex(F.substring(raw, at, F.lit(1))).between("80", "BF")


def clip_bytes(text: Column, budget: Column | int) -> Column:
    """The longest prefix of whole code points within a byte budget; a budget below 1 gives an empty text."""
    raw, b = text.cast("binary"), (F.lit(budget) if isinstance(budget, int) else budget).cast("int")
    cut = F.when(~_continues(raw, b + 1), b).when(~_continues(raw, b), b - 1).when(~_continues(raw, b - 1), b - 2).otherwise(b - 3)
    return F.when(F.octet_length(text) <= b, text).when(b < 1, F.lit("")).otherwise(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))).cast("string"))


def clip_middle(text: Column, budget: Column | int) -> Column:
    """Head and tail of whole code points within a byte budget, a mark between; a text that fits stays."""
    raw, size = text.cast("binary"), F.octet_length(text)
    b = (F.lit(budget) if isinstance(budget, int) else budget).cast("int")
    half = F.floor(F.greatest(b - len(MARK.encode()), F.lit(0)) / 2).cast("int")
    at = size - half + 1
    at = F.when(~_continues(raw, at), at).when(~_continues(raw, at + 1), at + 1).when(~_continues(raw, at + 2), at + 2).otherwise(at + 3)
    tail = F.when(half > 0, F.substring(raw, at, size).cast("string")).otherwise("")
    return F.when(size <= b, text).otherwise(F.concat(clip_bytes(text, half), F.lit(MARK), tail))


def clip(df: DataFrame, text_col: str, budget: int, out: str) -> DataFrame:
    """df with the clipped text in column out; null is empty."""
    return df.withColumn(out, clip_middle(F.coalesce(F.col(text_col), F.lit("")), budget))


def greedy_pack(df: DataFrame, by: list[str], order: list[str], size: Column, budget: int, max_items: int | None = None, separator: int = 0, base: int = 0, boundary: Column | None = None, distinct: str | None = None) -> DataFrame:
    """Packs each group's rows, in order, into batches: a row that would exceed the budget (or the count) opens a new one.

    A row where `boundary` holds also opens one once the batch is half full; with `distinct`, max_items counts that column's
    values instead of rows. Returns df's columns with batch. One shuffle by group and a sort; the fold then reads a partition as
    a stream of Arrow batches and keeps a few numbers, however long a group is. A null size counts 0; nulls are one group.
    """
    importable(df.sparkSession)
    at, marks = df.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0))), F.lit(False) if boundary is None else F.coalesce(boundary, F.lit(False))
    rows = at.withColumn("__mark", marks).withColumn("__item", F.col(distinct) if distinct else F.lit(None).cast("int"))
    schema, names = StructType([*df.schema.fields, StructField("batch", IntegerType())]), df.columns

    def fold(frames):
        group, batch, used, items, last = None, -1, 0, 0, None
        for frame in frames:
            keys = zip(*[frame.column(c).to_pylist() for c in by], strict=True)
            out = []
            for key, n, mark, item in zip(keys, *[frame.column(c).to_pylist() for c in ("__size", "__mark", "__item")], strict=True):
                fresh = distinct is None or item != last
                if key != group:
                    group, batch, opens = key, -1, True
                else:
                    opens = used + separator + n > budget or (mark and used >= budget // 2)
                    opens = opens or (max_items is not None and fresh and items >= max_items)
                if opens:
                    batch, used, items = batch + 1, base + n, 1
                else:
                    used, items = used + separator + n, items + fresh
                last = item
                out.append(batch)
            kept = [frame.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.int32())], names=[*names, "batch"])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(fold, schema)


def prefix_fit(df: DataFrame, by: list[str], order: str, size: Column, budget: int, base: int = 2, chunk: int = 4096) -> DataFrame:
    """The longest prefix of each group whose sizes, one byte more each, fit; never skips a row. order is a whole number, not null.

    Sizes are summed by runs of `chunk` order values first; only runs that begin within the budget are read row by row.
    """
    placed = df.withColumn("__n", size + 1).withColumn("__run", F.floor(F.col(order) / chunk))
    sums = placed.groupBy(*by, "__run").agg(F.sum("__n").alias("__s"))
    before = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select(*by, "__run", (F.lit(base) + F.coalesce(F.sum("__s").over(before), F.lit(0))).alias("__begun")).where(F.col("__begun") <= budget)
    w = Window.partitionBy(*by, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fit = null_safe_join(placed, begun, [*by, "__run"]).withColumn("used_bytes", F.col("__begun") + F.sum("__n").over(w))
    return fit.where(F.col("used_bytes") <= budget).select(*df.columns, "used_bytes")


def read_span(text: Column, start: Column, end: Column) -> Column:
    """The bytes of an address."""
    return F.substring(F.encode(text, "UTF-8"), start + 1, end - start)


def segment_tree(df: DataFrame, group: str, count: str, fanout: int = 6) -> DataFrame:
    """Nodes (group, start_seg, end_seg, depth) of a balanced tree over count segments, by a bounded descent."""
    level = df.where(F.col(count) > 0).select(group, F.lit(0).cast("long").alias("start_seg"), F.col(count).cast("long").alias("end_seg"), F.lit(0).alias("depth"))
    out = level
    deepest = df.agg(F.max(count)).first()[0] or 0
    depth, reach = 0, 1
    while reach < deepest:
        reach *= fanout
        depth += 1
        wide = F.ceil((F.col("end_seg") - F.col("start_seg")) / fanout)
        level = level.where(F.col("end_seg") - F.col("start_seg") > 1).select(group, "end_seg", wide.alias("w"), F.explode(F.sequence("start_seg", F.col("end_seg") - 1, wide)).alias("start_seg"))
        level = level.select(group, "start_seg", F.least(F.col("start_seg") + F.col("w"), "end_seg").alias("end_seg"), F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out


