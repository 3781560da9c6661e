"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules work on each text alone. The cross-document rule hashes normalised lines, counts the documents of a host
that hold each line, removes lines above the limit and rejects documents that keep too few of their words.

Defined cases: a null text counts as empty (no words, base rules fail); a null host is a host of its own; rows that
repeat both id and text are one document of that many copies, each copy counted as a document of the host; a null id
is kept. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hash128, let, pick, words

WINDOW = 5


def repeated_words(tokens: Column, width: int = WINDOW) -> Column:
    """How many words stand in windows of `width` words that occur twice or more in the text, the first included."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def doubled(run: Column) -> Column:
        same = F.filter(run, lambda x, j: (F.get(run, j - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(run, j + 1)["h"] == x["h"]).eqNullSafe(True))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def of_windows(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, doubled))

    def of_hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - width)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])), of_windows)

    return F.when(F.size(tokens) < width, F.lit(0).cast("long")).otherwise(let(F.transform(tokens, lambda x: F.xxhash64(x)), of_hashes))


def repeated_lines(text: Column) -> Column:
    """How many lines with a word equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_signals(docs: DataFrame, *, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row for each document: its key, host and the signals of the base rules. The text itself goes no further."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return (
        docs.select(
            docs[id_col].alias("id"), F.xxhash64(text).alias("t"), docs[host_col].alias("host"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            repeated_lines(text).alias("n_dup_lines"),
            let(words(text), word_signals).alias("s"),
        )
        .select("id", "t", "host", "n_symbols", "n_dup_lines", "s.*")
    )


def word_signals(w: Column) -> Column:
    """What is counted in the words of a text."""
    return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))


def document_lines(docs: DataFrame, *, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The distinct normalised lines of each document with their words; one more row without a hash marks the document."""
    text = F.coalesce(docs[text_col], F.lit(""))
    norm = F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE + "+", " "))))
    hashed = F.transform(F.filter(norm, lambda x: x != ""), lambda x: F.struct(*hash128(x), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("long").alias("n")))

    def distinct(run: Column) -> Column:
        """Equal lines follow each other in the sorted run: the first of each stays."""
        return F.filter(run, lambda x, j: ~((F.get(run, j - 1)["h1"] == x["h1"]) & (F.get(run, j - 1)["h2"] == x["h2"])).eqNullSafe(True))

    marker = F.array(F.struct(F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(0).cast("long").alias("n")))
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("t"), docs[host_col].alias("host"), F.explode(F.concat(marker, let(F.sort_array(hashed), distinct))).alias("l")).select("id", "t", "host", "l.*")


def line_frequency_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_docs: int = 10, min_share: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20,
) -> DataFrame:
    """Applies base rules and the line frequency rule.

    A line is removed where more than `max_docs` documents of its host hold it. A document is rejected if the words of
    its distinct remaining lines are less than `min_share` of the words of its distinct lines.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_words,
    removed_words, kept: one row for each input row.
    """
    docs = pick(docs, [id_col, text_col, host_col])
    cols = {"id_col": id_col, "text_col": text_col, "host_col": host_col}
    lines = document_lines(docs, **cols)
    common = lines.where("h1 is not null").groupBy("host", "h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs).select(F.col("host").alias("c_host"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    hit = lines.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    copies = F.sum(F.col("h1").isNull().cast("long"))
    totals = hit.groupBy(F.col("id").alias("l_id"), F.col("t").alias("l_t"), F.col("host").alias("l_host")).agg(
        (F.sum("n") / copies).cast("long").alias("line_words"), (F.sum(F.when(F.col("c1").isNotNull(), F.col("n")).otherwise(0)) / copies).cast("long").alias("removed_words")
    )
    base = base_signals(docs, **cols)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rest = F.col("line_words") - F.col("removed_words")
    return (
        base.join(totals, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("t") == F.col("l_t")) & F.col("host").eqNullSafe(F.col("l_host")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (rest >= F.lit(min_share) * F.col("line_words")))
        .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_words", "removed_words", "kept")
    )


def without_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10) -> DataFrame:
    """id_col, host_col, cleaned_text and removed_lines: each row's text without the lines that more than `max_docs` documents of its host hold.

    Blank lines stay; rows that repeat id, text and host are copies of one document, each copy counted, and get the same text.
    """
    docs = pick(docs, [id_col, text_col, host_col])
    text = F.coalesce(docs[text_col], F.lit(""))
    norm = lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE + "+", " ")))
    placed = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), norm(x).alias("k"))), lambda x: x["k"] != "")
    lines = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("t"), docs[host_col].alias("host"), F.explode(F.transform(placed, lambda x: F.struct(x["pos"].alias("pos"), *hash128(x["k"])))).alias("l")).select("id", "t", "host", "l.*")
    distinct = document_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col).where("h1 is not null")
    common = distinct.groupBy("host", "h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs).select(F.col("host").alias("c_host"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    hit = lines.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    gone = hit.groupBy(F.col("id").alias("g_id"), F.col("t").alias("g_t"), F.col("host").alias("g_host")).agg(F.collect_set("pos").alias("gone"))
    keyed = docs.select(docs[id_col].alias("id"), docs[host_col].alias("host"), text.alias("whole"), F.xxhash64(text).alias("t"))
    out = keyed.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("t") == F.col("g_t")) & F.col("host").eqNullSafe(F.col("g_host")), "left")
    stay = F.filter(F.split("whole", "\n"), lambda x, i: ~F.array_contains("gone", i))
    cleaned = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(stay, "\n"))
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("host").alias(host_col), cleaned.alias("cleaned_text"), removed.alias("removed_lines"))
