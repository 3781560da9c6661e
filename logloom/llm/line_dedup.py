"""Exact line dedup against levelled sorted runs of line hashes.

`LineRuns` keeps, in the shared folder, runs of (line hash, documents that hold it, largest document id). A run is dealt
into buckets by hash and sorted within them, one file for each, so the merge-anti-join of a batch with a run needs
neither a shuffle nor a sort. What no run has becomes a run of level 0; hashes that a run has already are counted apart.
When a level has `fanout` runs, they are merged into one run of the next, again without a shuffle.

`dedup_lines` feeds a table through the runs in batches of falling ids, so that the first batch that holds a line holds its
keeper. Lines found in `min_docs` documents then stay only in the largest id that holds them.

Defined cases: a null or empty text is one empty line; a null id counts as one document below all others; rows that
repeat an id are one document; equal lines within the keeper all stay; keys shorter than `min_chars` code points
always stay. Extra columns are ignored; a carried column named like an output column is refused. An empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Sequence
from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hash128, pick, refuse, remove, scratch, settings, stored_at

#: Fixed value: the white space that a key is stripped of.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return fold(F.btrim(line, F.lit(BLANKS)))


def document(id_col: Column, text: Column) -> list[Column]:
    """i, no_id and t, never null: a document's id, and a hash that tells texts of a repeated id apart."""
    return [F.coalesce(id_col.cast("long"), F.lit(0).cast("long")).alias("i"), id_col.isNull().alias("no_id"), F.xxhash64(text).alias("t")]


def candidate_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, i, no_id, t, pos, h1, h2) of every line whose key is long enough."""
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("k"))), lambda x: F.length(x["k"]) >= min_chars)
    hashed = F.transform(keyed, lambda x: F.struct(x["pos"].alias("pos"), *hash128(x["k"])))
    return docs.select(docs[id_col].cast("long").alias("id"), *document(docs[id_col], text), F.explode(hashed).alias("l")).select("id", "i", "no_id", "t", "l.*")


#: Within it, a scan of a run knows that its buckets are sorted.
SORTED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def sorted_scans(spark: SparkSession) -> AbstractContextManager[None]:
    return settings(spark, SORTED)


def unname(spark: SparkSession, names: Sequence[str]) -> None:
    """Takes tables out of the catalogue; their files stay, for frames that read them."""
    try:
        for name in names:
            spark.sql(f"drop table if exists {name}")
    except Exception:  # the session has ended, and its catalogue with it
        return


class LineRuns:
    """The runs of one corpus. `levels[k]` lists the tables of level k's runs; no hash is in two runs."""

    SCHEMA = "h1 long, h2 long, n_docs long, keeper long"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, buckets: int | None = None, counts: bool = True) -> None:
        """Without counts, what a run has already isn't counted, and seen() knows the first batch of a hash only."""
        self.spark, self.path, self.fanout, self.counts = spark, path or scratch(spark, "line-runs"), fanout, counts
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.met: list[str] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made: list[str] = []
        self._unnamed = weakref.finalize(self, unname, spark, self.made)  # where close() isn't called
        self._unnamed.atexit = False

    def _save(self, rows: DataFrame, batched: bool = False) -> str:
        name = f"{self.name}_{len(self.made)}"
        self.made.append(name)
        out = rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}")
        with sorted_scans(self.spark):
            (out.partitionBy("batch") if batched else out).saveAsTable(name)
        return name

    def _drop(self, names: Sequence[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
        remove(self.spark, *[f"{self.path}/{name}" for name in names])

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def entries(self, lines: DataFrame, batches: int) -> DataFrame:
        """(batch, h1, h2, n_docs, keeper) of all batches of lines (id, batch, h1, h2), dealt out as runs are, in one pass."""
        each = lines.groupBy("h1", "h2", "id", "batch").agg(F.lit(1).alias("one"))  # a hot hash is spread by id, then counted before it moves
        at = [F.when(F.col("batch") == k, F.struct(F.col("id").alias("id"))) for k in range(batches)]
        wide = each.groupBy("h1", "h2").agg(*[F.count(x).alias(f"n{k}") for k, x in enumerate(at)], *[F.max(x).alias(f"k{k}") for k, x in enumerate(at)])
        some = F.filter(F.array(*[F.struct(F.lit(k).alias("batch"), F.col(f"n{k}").alias("n_docs"), F.col(f"k{k}.id").alias("keeper")) for k in range(batches)]), lambda x: x["n_docs"] > 0)
        return self.spark.table(self._save(wide.select("h1", "h2", F.explode(some).alias("e")).select("h1", "h2", "e.n_docs", "e.keeper", "e.batch"), batched=True))

    def add(self, lines: DataFrame) -> None:
        """Adds a batch (id, h1, h2, ...). A document's lines must all come in one batch, or they count once for each."""
        self.add_entries(lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")))

    def add_entries(self, own: DataFrame) -> None:
        """Adds a batch's (h1, h2, n_docs, keeper): what no run has is a new run; the rest is counted apart."""
        older = self.runs()
        fresh = self._save(self.new_lines(own))
        if older and self.counts:
            self.met.append(self._save(self._less(own, self.spark.table(fresh))))
        self.levels[0].append(fresh)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)

    def compact(self, level: int) -> None:
        """Merges all runs of a level into one of the next, bucket by bucket without a shuffle, and deletes them."""
        (first, *others), self.levels[level] = self.levels[level], []
        for other in others:
            merged = self._save(self._merged(first, other))
            self._drop([first, other])
            first = merged
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(first)

    def _merged(self, a: str, b: str) -> DataFrame:
        more = self.spark.table(b).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("n_docs").alias("r_docs"), F.col("keeper").alias("r_keeper")).hint("merge")
        both = self.spark.table(a).join(more, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "full_outer")
        zero = F.lit(0).cast("long")
        return both.select(F.coalesce("h1", "r1").alias("h1"), F.coalesce("h2", "r2").alias("h2"), (F.coalesce("n_docs", zero) + F.coalesce("r_docs", zero)).alias("n_docs"), F.greatest("keeper", "r_keeper").alias("keeper"))

    @staticmethod
    def _less(lines: DataFrame, run: DataFrame) -> DataFrame:
        return lines.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """The merge-anti-join of a batch with every run: the lines that no earlier batch has."""
        for run in self.runs():
            lines = self._less(lines, run)
        return lines

    def seen(self, min_docs: int = 1) -> DataFrame:
        """All hashes of at least `min_docs` documents."""
        names = [*[name for level in self.levels for name in level], *self.met]
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        # the planner takes a union of bucketed scans for dealt out by (h1, h2), which it isn't: deal it out by another key
        dealt = out.repartition(self.buckets, "h1")
        return dealt.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")).where(F.col("n_docs") >= min_docs)

    def keepers(self, hashes: DataFrame) -> DataFrame:
        """(h1, h2, keeper) of hashes (h1, h2) by a merge join with each run; a hash is in one run only."""
        found = [hashes.select("h1", "h2").join(run.select("h1", "h2", "keeper").hint("merge"), ["h1", "h2"]) for run in self.runs()]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def close(self) -> None:
        """Deletes all runs."""
        self._unnamed.detach()
        self._drop(self.made)
        remove(self.spark, self.path)


def batch_of(ids: DataFrame, batches: int) -> Column:
    """The batch of an id, falling: batch 0 has the largest ids, the last one the null id."""
    bounds = ids.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    return sum((F.when(F.coalesce(F.col("id") >= F.lit(b), F.lit(False)), 0).otherwise(1) for b in bounds), F.lit(0))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), min_chars: int = 20, min_docs: int = 3, batches: int = 4,
) -> DataFrame:
    """Returns id_col, the carried columns, kept_text, n_lines and n_dropped: one row for each input row."""
    spark = docs.sparkSession
    carry = [c for c in carry if c not in (id_col, text_col)]
    refuse([id_col, *carry], ["kept_text", "n_lines", "n_dropped"])
    docs = pick(docs, [id_col, text_col, *carry])
    batch = batch_of(docs.select(docs[id_col].cast("long").alias("id")), batches)
    lines, lines_at = stored_at(candidate_lines(docs, id_col, text_col, min_chars).withColumn("batch", batch), "lines")
    runs = LineRuns(spark, counts=False)
    own = runs.entries(lines, batches)
    for k in range(batches):
        runs.add_entries(own.where(F.col("batch") == k).drop("batch"))
    counted = own.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    with sorted_scans(spark):
        often, often_at = stored_at(runs.keepers(counted), "line-counts")
    runs.close()
    # both sides are plain shuffles here: adaptive execution deals a hot line out over many tasks
    hit = lines.join(often, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    gone, _ = stored_at(hit.groupBy("i", "no_id", "t").agg(F.collect_set("pos").alias("gone")), "lines-gone")
    remove(spark, lines_at, often_at)
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *document(docs[id_col], F.coalesce(docs[text_col], F.lit(""))))
    out = keyed.join(gone, ["i", "no_id", "t"], "left").withColumn("parts", F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("parts"), i)), "\n"))
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return out.select(*[F.col(f"row.`{c}`") for c in (id_col, *carry)], kept.alias("kept_text"), F.size("parts").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))
