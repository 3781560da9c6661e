"""Mixing sources to target weights by blocks.

The words of a source, its documents laid end to end, are packed into blocks of fixed length. For every output shard a
multinomial draw without replacement from the quotas left gives how many slots each source gets, so the counts over
all shards meet the quotas. A source's n-th slot takes the block that a pseudorandom permutation of its block indexes,
another for each pass, gives; slots and blocks meet in a join by (source, index).

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. They share all words by weight; a source
stops at `max_passes` times its size, and what it can't take is shared by the others by weight until none is above.

Defined cases: a null text has no words; a document without words is in no block and is taken 0 times; sources without
words get target 0. Documents are laid out by (salt, id, hash of text and source); rows that repeat all three are laid out
next to each other, each with words of its own in the blocks. Extra columns are ignored. The result depends on
the rows and the seed only, not on partitioning. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let, pick, words

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
ROUNDS = 12


def targets(sizes: Sequence[int], weights: Sequence[float], max_passes: float) -> list[float]:
    """Shares sum(sizes) by weight; none gets more than max_passes times its size, the excess is shared again."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > max_passes * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(max_passes * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in full]
    return out


def shard_counts(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: draws from the quotas left; the columns add up to the quotas."""
    rng = np.random.default_rng(seed)
    left = np.array(quotas, dtype=np.int64)
    out = np.zeros((shards, len(left)), dtype=np.int64)
    for k in range(shards):
        room = int(round(left.sum() / (shards - k)))
        want = rng.multinomial(room, left / left.sum()) if left.sum() else np.zeros_like(left)
        want = np.minimum(want, left)
        for i in np.argsort(-(left - want), kind="stable"):  # what a spent source can't give comes from the fullest
            more = min(room - want.sum(), left[i] - want[i])
            want[i] += more
        out[k], left = want, left - want
    return out


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 for each key: a swap-or-not shuffle.

    A round reflects x about a point drawn from the key and swaps the two if the hash of the pair says so; every round
    is one to one, so the whole is.
    """

    def swapped(x: Column, partner: Column, r: Column) -> Column:
        return F.when(F.pmod(F.xxhash64(r, key, F.lit("swap"), F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    def one_round(x: Column, r: Column) -> Column:
        return let(F.pmod(F.pmod(F.xxhash64(r, key), n) + n - x, n), lambda partner: swapped(x, partner, r))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, one_round)


def source_plan(placed: DataFrame, block_words: int, max_passes: int) -> list[dict]:
    """One entry for each source (their number is bounded by the catalogue of sources, not by rows), in order."""
    rows = placed.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in rows]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))], max_passes)
    plan = []
    for i, r in enumerate(rows):
        blocks = -(-sizes[i] // block_words)
        slots = min(round(goal[i] / sizes[i] * blocks), max_passes * blocks) if sizes[i] else 0
        plan.append({"s": i, "source": r["source"], "source_size": sizes[i], "target": goal[i], "blocks": blocks, "slots": slots})
    return plan


def text_key(text: Column, source: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), source)


def place(docs: DataFrame, id_col: str, text_col: str, source_col: str, salts: int) -> DataFrame:
    """(id, t, source, size, start): where each document's words begin among its source's, without a window over a whole source.

    Documents fall into `salts` bins of each source; a window over the bins' totals, then one within each bin.
    """
    sized = docs.select(docs[id_col].alias("id"), text_key(docs[text_col], docs[source_col]).alias("t"), docs[source_col].alias("source"), F.size(words(docs[text_col])).cast("long").alias("size"))
    sized = sized.withColumn("bin", F.pmod(F.xxhash64("id", "t"), F.lit(salts)))
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bin").orderBy("id", "t").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
        .select("id", "t", "source", "size", (F.col("base") + F.col("inner")).alias("start"))
    )


def mix_slots(spark: SparkSession, plan: Sequence[dict], shards: int, seed: int) -> DataFrame:
    """(shard, slot, s, block, pass_no): what every slot of every shard takes."""
    counts = shard_counts([p["slots"] for p in plan], shards, seed)
    firsts = np.cumsum(counts, axis=0) - counts
    rows = [(k, i, int(firsts[k, i]), int(counts[k, i]), plan[i]["blocks"]) for k in range(shards) for i in range(len(plan)) if counts[k, i]]
    if not rows:
        return spark.createDataFrame([], "shard int, slot long, s int, block long, pass_no long")
    drawn = spark.createDataFrame(rows, "shard int, s int, first long, n long, blocks long")
    # runs of bounded length, dealt out evenly, before a row for each slot is made
    run = 4096
    runs = drawn.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(run))).alias("at")).repartition(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard", "s", "at")
    each = runs.select("shard", "s", "blocks", "first", F.explode(F.sequence(F.col("at"), F.least(F.col("n"), F.col("at") + run) - 1)).alias("slot"))
    turn = F.col("first") + F.col("slot")
    pass_no = F.floor(turn / F.col("blocks"))
    return each.select("shard", "slot", "s", permuted(F.pmod(turn, F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("s"), pass_no)).alias("block"), pass_no.alias("pass_no"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = 32, shards: int = 64, max_passes: int = 3, seed: int = 7, salts: int = 512,
) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, pieces).

    documents: id, t, source, size, start, s, source_size, target: one row for each input row.
    pieces: shard, slot, pass_no, block, id, t, start, word_from, n_words: the words, by position in the document
    (word_from from 0), that a slot takes of each document in its block.
    """
    spark = docs.sparkSession
    placed = cut(place(pick(docs, [id_col, text_col, source_col]), id_col, text_col, source_col, salts))
    plan = source_plan(placed, block_words, max_passes)
    told = spark.createDataFrame([(p["s"], p["source"], p["source_size"], p["target"]) for p in plan], "s int, p_source string, source_size long, target double")
    documents = placed.join(told, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    first, end = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    block_of = documents.where("size > 0").select("id", "t", "s", "start", "size", F.explode(F.sequence(first, end)).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    blocks = block_of.select("s", "block", "id", "t", "start", (lo - F.col("start")).alias("word_from"), (hi - lo).alias("n_words"))
    # both sides grow with the corpus, though the planner's estimate of the slots is small: never broadcast them
    return documents, mix_slots(spark, plan, shards, seed).join(blocks.hint("merge"), ["s", "block"])
