"""What Python workers need of the driver, and frames that are made once."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets workers started from here import this package wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


_MADE: list[str] = []


def remembered(spark: SparkSession, path: str) -> str:
    """path, to be deleted when this program ends; frames that read it may be in use until then."""
    if not _MADE:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def clean() -> None:
            for made in reversed(_MADE):
                try:
                    told = jvm.org.apache.hadoop.fs.Path(made)
                    told.getFileSystem(conf).delete(told, True)
                except Exception:  # the JVM is gone: nothing can be deleted through it any more
                    return

        atexit.register(clean)
    _MADE.append(path)
    return path


def _fresh(spark: SparkSession) -> str:
    """A new path in the shared folder, spark.checkpoint.dir, or in a new one where that is unset and all is on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or remembered(spark, tempfile.mkdtemp(prefix="logloom-")))
    return remembered(spark, f"{sc.getCheckpointDir()}/kept-{uuid.uuid4().hex}")


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df, computed once and read back from the shared folder.

    A written table outlives executors as a checkpoint does, and df is computed once for it instead of twice. It is deleted when
    the program ends.
    """
    path = _fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept_once(df: DataFrame) -> DataFrame:
    """kept_at() without the path."""
    return kept_at(df)[0]


def dealt_once(df: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """kept_once() in buckets of by, as a shuffle deals them out: joins and groups on just these columns don't shuffle it again.

    There are as many buckets as a shuffle has partitions, but at least `least`.
    """
    spark = df.sparkSession
    name, n = f"dealt_{uuid.uuid4().hex}", max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    # dealt out as the buckets are, so that a task writes one file
    df.repartition(n, *by).write.format("parquet").option("path", _fresh(spark)).bucketBy(n, *by).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: the files lie outside the warehouse, and the frame has read where
    return table


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that no frame in use reads, and lets Spark drop the shuffle files that led to it."""
    told = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    told.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(told, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
