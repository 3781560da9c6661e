"""Sources and sinks of an execution-log analysis: manifests, archives of predictions and calls, reports, frozen configs."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.segment import clip_middle

STEP = "array<struct<step:int,name:string,role:string,content:string>>"
CASE = f"question_ID string, mistake_agent string, mistake_step int, history {STEP}"


def read_cases(spark: SparkSession, root: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected): the JSON files that a manifest (path, question_ID, sha256) lists, checked and parsed.

    A file is rejected if its digest differs, it isn't in the manifest, or its steps aren't 0 .. n-1. source is the file's folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    named = files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "content", F.sha2("content", 256).alias("found"))
    j = named.join(manifest, "path", "left")
    c = j.withColumn("case", F.from_json(F.decode("content", "UTF-8"), CASE)).withColumn("source", F.split("path", "/")[0])
    order = F.transform("case.history", lambda h: h["step"])
    whole = F.coalesce(order == F.sequence(F.lit(0), F.size("case.history") - 1), F.lit(False))
    why = F.when(F.col("sha256").isNull(), "not_listed").when(F.col("found") != F.col("sha256"), "digest").when(~whole, "steps")
    judged = c.withColumn("reason", why)
    return judged.where("reason is null").select("case.*", "source"), judged.where("reason is not null").select("path", "reason")


def explode_steps(cases: DataFrame, budget: int | None = None) -> DataFrame:
    """One row for each step, its content clipped to a budget of bytes if there is one; labels aren't among the columns."""
    rows = cases.select("question_ID", "source", F.explode("history").alias("h")).select("question_ID", "source", "h.*")
    return rows if budget is None else rows.withColumn("content", clip_middle(F.coalesce("content", F.lit("")), budget))


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON predictions, plain or gzip; question_id is the file's name."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("question_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json", 1))


def read_calls(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An archive of calls, a folder for each case."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("case_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones don't count."""
    return spark.read.schema(schema).json(path).na.drop("all")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], nested: str = "prediction") -> None:
    """The named columns; one that is missing at the top is taken from the nested struct; booleans print as True and False."""
    inner = df.schema[nested].dataType.names if nested in df.columns else []
    out = []
    for c in columns:
        parts = ([F.col(c)] if c in df.columns else []) + ([F.col(f"{nested}.{c}")] if c in inner else [])
        value = F.coalesce(*parts) if parts else F.lit(None).cast("string")
        kind = df.select(value.alias("v")).schema["v"].dataType
        out.append((F.initcap(value.cast("string")) if isinstance(kind, T.BooleanType) else value).alias(c))
    df.select(*out).write.mode("overwrite").option("header", "true").csv(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small metric frame as a report table."""
    rows = df.limit(most).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows)])


def config_digest(config: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def freeze_config(spark: SparkSession, path: str, run: str, config: dict[str, Any]) -> str:
    """Records a run's configuration; a run whose recorded one differs is refused.

    A run's record is a file of its own, made only if it isn't there yet, so of two runs that start at once one makes it and the
    other reads it.
    """
    own = config_digest(config)
    name = f"{path}/{hashlib.sha256(run.encode()).hexdigest()}.json"
    if not _create(spark, name, json.dumps({"run": run, "digest": own, "config": config}, sort_keys=True, ensure_ascii=False)):
        if json.loads(read_text(spark, name))["digest"] != own:
            raise ValueError(f"run {run} was begun with another configuration")
    return own


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of a path of any scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole unless it is there; whether it was made."""
    fs, at = _place(spark, path)
    if fs.exists(at):
        return False
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    _write(spark, draft, text)
    try:  # without OVERWRITE a rename onto a file is refused
        _rename(spark, draft, path, over=False)
    except Py4JJavaError:
        fs.delete(_place(spark, draft)[1], False)
        if not fs.exists(at):
            raise
        return False
    return True


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _place(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _rename(spark: SparkSession, draft: str, path: str, over: bool) -> None:
    jvm, (fs, at) = spark._jvm, _place(spark, path)
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, int(over))
    if over:
        how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_place(spark, draft)[1], at, how)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """A small JSON file that readers see whole, the old one or the new one: written aside, then renamed over it."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    _write(spark, draft, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    _rename(spark, draft, path, over=True)


def write_json_rows(df: DataFrame, path: str, gzip: bool = True) -> None:
    """A row a line, read back by read_predictions or read_jsonl."""
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that say anything, as a log of retries is counted."""
    return spark.read.text(path).agg(F.count_if(F.trim("value") != "")).first()[0]


def splice_section(text: str, title: str, marker: str, section: str) -> str:
    """A report with the section put before the marker, in place of an older one that begins with the title.

    Without the marker the section goes to the end; of several markers the first after the old section counts.
    """
    start = text.find(title)
    if start >= 0:
        end = text.find(marker, start)
        text = text[:start] + (text[end:] if end >= 0 else "")
    before, found, after = text.partition(marker)
    return f"{before}{section}\n{found}{after}"


def check_no_labels(df: DataFrame, labels: tuple[str, ...] = ("mistake_agent", "mistake_step", "mistake_reason", "ground_truth")) -> DataFrame:
    """df itself, refused if a label is among its columns or the fields of its structs, at any depth."""

    def names(kind: T.DataType) -> set[str]:
        if isinstance(kind, T.StructType):
            return {f.name for f in kind.fields}.union(*[names(f.dataType) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return names(kind.elementType)
        if isinstance(kind, T.MapType):
            return names(kind.keyType) | names(kind.valueType)
        return set()

    leaked = names(df.schema) & set(labels)
    if leaked:
        raise ValueError(f"labels among what a model would see: {sorted(leaked)}")
    return df
