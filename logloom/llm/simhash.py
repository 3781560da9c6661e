"""SimHash fingerprints of documents, and the search for all of them within a Hamming radius.

Terms are the five-word shingles of a text (A-Z lower-cased); each occurrence votes, so a term weighs as often as it
stands there. A fingerprint has 256 bits, written as 64 hex digits; likeness is the share of equal bits.

`hamming_pairs` cuts fingerprints into radius + 1 blocks. Two within the radius agree in a block, so the tables of
(block, value), one for each block brought to the front, hold every pair; only distinct fingerprints meet there.

Defined cases: a null text counts as empty; no words give the fingerprint of zero bits; fewer than five words are one
term; a null id sorts before all others; rows that repeat an id are ordered by their text's hash; a table's only row is
its own next document. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, ship, stored
from .shingles import mixed, shingle_hashes

LANES = 4  # of 64 bits
BITS = 64 * LANES
#: Which bits each byte value sets.
SET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
OFFSETS = np.arange(8 * LANES, dtype=np.int64) * 256
STEP = 8192


def fingerprint(text: str) -> np.ndarray:
    """The fingerprint's bytes. Votes are counted by byte value: 32 histograms instead of 256 sums for each term."""
    terms = shingle_hashes(text)
    counts = np.zeros(256 * 8 * LANES, dtype=np.int64)
    for at in range(0, len(terms), STEP):
        part = terms[at : at + STEP]
        lanes = np.stack([mixed(part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) for k in range(LANES)], axis=1)
        counts += np.bincount((lanes.view(np.uint8).reshape(len(part), 8 * LANES) + OFFSETS).ravel(), minlength=len(counts))
    ones = counts.reshape(8 * LANES, 256) @ SET_BITS
    return np.packbits(2 * ones.ravel() > len(terms))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


PAIR = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in PAIR.split(", ")]


def compared(doc_id: int | None, text: str, own: np.ndarray, following: str, following_print: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, following_print)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


ARROW = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OPEN = ARROW.append(pa.field("kind", pa.string())).append(pa.field("part", pa.int32())).append(pa.field("text", pa.string()))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row with the next of its partition; the first row's text and the last row go on for the seams."""
    last, part = None, None
    for batch in batches:
        out = []
        for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "part")), strict=True):
            own = fingerprint(text)
            if last is None:
                out.append((doc_id, None, None, None, None, None, None, "head", part, text))
            else:
                out.append((*compared(*last, text, own), "pair", part, None))
            last = (doc_id, text, own)
        yield _batch(out, OPEN)
    if last is not None:
        yield _batch([(last[0], None, None, None, None, None, None, "tail", part, last[1])], OPEN)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("id", "text", "following")), strict=True)
        yield _batch([compared(i, t, fingerprint(t), f, fingerprint(f)) for i, t, f in rows], ARROW)


def fingerprints_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row for each input row, as PAIR says, id as id_col.

    Texts are dealt out once, by ranges of ids; neighbours meet within a range, and the seams between ranges, one row for
    each, in a second, small step.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = pick(docs, [id_col, text_col])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs[text_col], F.lit(""))
    ranged = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t")).repartitionByRange(n, "id", "t").sortWithinPartitions("id", "t")
    ordered = ranged.select("id", "text", F.spark_partition_id().alias("part"))
    rows = stored(ordered.mapInArrow(_within, PAIR + ", kind string, part int, text string"), "simhash")
    # at most one head and one tail for each partition; only part numbers are ordered in one task, texts are joined to them
    ends = rows.where("kind <> 'pair'")
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.select("part").distinct().select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(whole)).alias("next_part"))
    tails = ends.where("kind = 'tail'").select("id", "text", "part").join(after, "part")
    joined = tails.join(ends.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following")).hint("merge"), "next_part").select("id", "text", "following")
    out = rows.where("kind = 'pair'").select(*NAMES).unionByName(joined.mapInArrow(_seams, PAIR))
    return out.withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array([fingerprint(t or "").tobytes().hex() for t in batch.column(text_col).to_pylist()], pa.string())], names=[id_col, "fingerprint"])

    return pick(docs, [id_col, text_col]).mapInArrow(run, f"`{id_col}` long, fingerprint string")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hex."""
    half = lambda x, k: F.conv(F.substring(x, k * 8 + 1, 8), 16, 10).cast("long")
    return sum((F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in range(1, BITS // 32)), F.bit_count(half(a, 0).bitwiseXOR(half(b, 0))))


def hamming_pairs(prints: DataFrame, *, id_col: str = "doc_id", radius: int = 7) -> tuple[DataFrame, DataFrame]:
    """Returns (pairs, members): pairs a, b, bits of class representatives whose fingerprints differ in 1 .. radius bits,
    and members id_col, class_id: the smallest id with the same fingerprint. Equal fingerprints never form pairs.
    """
    blocks = radius + 1
    if BITS // 4 % blocks:
        raise ValueError("radius + 1 must divide the hex digits of a fingerprint")
    wide = BITS // 4 // blocks
    classes = prints.groupBy("fingerprint").agg(F.min(id_col).alias("class_id"))
    members = prints.join(classes, "fingerprint").select(id_col, "class_id")
    cut_up = F.array(*[F.substring("fingerprint", k * wide + 1, wide) for k in range(blocks)])
    tables = classes.select("class_id", "fingerprint", F.posexplode(cut_up).alias("block", "value"))
    left, right = tables.select(F.col("class_id").alias("a"), F.col("fingerprint").alias("fa"), "block", "value"), tables.select(F.col("class_id").alias("b"), F.col("fingerprint").alias("fb"), "block", "value")
    met = left.join(right, ["block", "value"]).where("a < b")
    # a pair that meets in several tables counts in the first of them only
    first = sum((F.when((F.col("block") > k) & (F.substring("fa", k * wide + 1, wide) == F.substring("fb", k * wide + 1, wide)), 1).otherwise(0) for k in range(1, blocks)), F.when((F.col("block") > 0) & (F.substring("fa", 1, wide) == F.substring("fb", 1, wide)), 1).otherwise(0))
    return met.where(first == 0).withColumn("bits", distance(F.col("fa"), F.col("fb"))).where(F.col("bits") <= radius).select("a", "b", "bits"), members
