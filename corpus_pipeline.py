"""The corpus pipeline: five stages over documents, each written and read again by whoever runs STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, langid, line_dedup, minhash, mixing
from logloom.llm.common import crc_mod, pick, remove, row_key, stored_at, table
from logloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go; lang becomes the predicted one.

    Where no row has a language none can be learnt: texts without a letter go, and lang stays null.
    """
    docs = pick(docs, COLUMNS)
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    if not model.languages:
        return docs.where(langid.has_letter(F.col("text")))
    found = langid.identify(docs, model, carry=COLUMNS)
    return found.where(F.col("lang_pred") != "und").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in one of them; a document of which no word is left goes."""
    out = line_dedup.dedup_lines(pick(docs, COLUMNS), carry=("lang", "source"))
    kept = out.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, Jaccard 0.8 or more, stays; of rows that repeat id and text, one."""
    return minhash.deduplicated(pick(docs, COLUMNS), percent=80)


#: A word with the white space behind it; the first one also with that before it. They make up the text.
WORD = r"(?:^[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document and pass of the mix: the words that the pass takes, in order, with the white space behind them.

    A pass that takes all words takes the text as it is. Rows that repeat id, text and source are documents of their own.
    """
    docs = pick(docs, COLUMNS)
    _, pieces = mixing.mix(docs)
    taken = pieces.groupBy("id", "t", "start", "pass_no").agg(F.sort_array(F.collect_list(F.struct("word_from", "n_words"))).alias("parts"))
    taken = taken.select(*row_key(F.col("id"), F.col("t")), "parts")
    row = F.struct("doc_id", "source", "lang", "n_chars", "text")
    held = docs.select(*row_key(F.col("doc_id").cast("long"), mixing.text_key(F.col("text"), F.col("source"))), row.alias("row")).groupBy("k1", "k2").agg(F.min("row").alias("row"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = held.join(taken, ["k1", "k2"]).select("row.*", "parts").withColumn("words", words)
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n_words"]) == F.size("words")
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("words", (p["word_from"] + 1).cast("int"), p["n_words"].cast("int")))), "")
    mixed = cut.withColumn("mixed", F.when(whole, F.col("text")).otherwise(some))
    return mixed.select("doc_id", F.col("mixed").alias("text"), "lang", "source", F.length("mixed").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text; a null text counts as empty."""
    vocabulary = bpe.load_vocabulary(tokenizer_path())
    hashed = pick(docs, COLUMNS).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    encoded = bpe.encode(hashed, vocabulary, carry=("doc_id", "lang", "source", "text_sha256"), decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_dedup), ("mixing sources", mixture), ("BPE", tokens)]

#: Language ID, MinHash and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = stored_at(docs, f"stage-{k}")
            if before:
                remove(spark, before)  # what this stage read is needed no more
            before = path
    return docs
