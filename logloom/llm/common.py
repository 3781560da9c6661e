"""Helpers shared by the training-data operators: table access, shared scratch folder, text expressions."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word separators of the contracts, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]"
#: The ASCII letters that a key folds.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new one in local mode only."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(told)
        return told
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle and checkpoint files that no frame refers to; long iterations would hold all of them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes a frame as Parquet below the shared folder and reads it back; for frames too large for checkpoint()."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """stored_at() without the path."""
    return stored_at(df, name)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that no frame in use reads."""
    for path in paths:
        told = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        told.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(told, True)


#: Rows and bytes of an Arrow batch: texts are long, and a worker, its JVM buffers included, holds a few batches at once.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers started from here import this package wherever the driver found it, and bounds their batches."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


@contextmanager
def settings(spark: SparkSession, told: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run within it; what was set before is set again after."""
    before = {key: spark.conf.get(key, None) for key in told}
    for key, value in told.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: What grows with the corpus is never gathered on the driver for a broadcast: both sides of a join are shuffled and merged.
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value to a lambda variable, so that an expression which uses it often evaluates it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def fold(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes, h1 and h2; together wide enough for the lines of a 100 TB corpus."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("second"), *cols).alias("h2")]


def row_key(id_col: Column, text: Column) -> list[Column]:
    """k1 and k2 tell documents apart by id and text (or a hash of it); null and empty are different."""
    # xxhash64 skips nulls: a flag tells them
    return [F.xxhash64(F.lit(n), id_col, id_col.isNull(), text, text.isNull()).alias(f"k{n}") for n in (1, 2)]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def refuse(carry: Sequence[str], made: Sequence[str]) -> None:
    if both := set(carry) & set(made):
        raise ValueError(f"carried columns are named like output columns: {sorted(both)}")


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, never reach an operator's own."""
    return df.select(*[df[f"`{c}`"] for c in columns])
