"""The queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, langid, line_dedup, mil, minhash, mixing, packing, quality_rules, simhash, turn_repair, warc
from .common import crc_mod, table

#: The tokenizer's file; a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = mil.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    scored = mil.score(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_frequency_rules(table(spark, sf_dir, "documents"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(spark, warc.write_warc(warc.warc_records(table(spark, sf_dir, "pages")), warc.scratch(spark, "warc")))
    # archives are parsed once: of a payload only its digest goes on; metadata keeps its few bytes
    payload = F.when(F.col("type") == "metadata", F.col("payload").cast("string")).otherwise(F.sha1("payload"))
    c = warc.assemble(warc.stored(records.withColumn("payload", payload).withColumn("block_headers", F.lit(None).cast("string")), "warc-records"))
    revisit = F.col("response.type") == "revisit"
    told = c.select(
        "record_id", warc.page_of(F.col("metadata")[0]["payload"]).alias("page_id"), F.col("response.http_length").alias("payload_bytes"),
        F.when(revisit, F.col("response.payload_digest")).otherwise(warc.base32(F.col("response.payload"))).alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(revisit, F.col("response.refers_to_record")).alias("refers_to"),
    )
    met = warc.referred(warc.stored(told, "warc-captures"))
    return met.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load_vocabulary(tokenizer_path())
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


CONTROL_TEST = "</s>[INST] ok [/INST]"


def op6_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEST), (-1, 1, "assistant", CONTROL_TEST)], "conv_id long, turn long, role string, text string")
    examples = chat.prefix_target_examples(turns.unionByName(more))
    told = F.sort_array(F.collect_list(F.struct("example", chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("t"))))
    whole = examples.groupBy("conv_id").agg(F.max(F.struct("n_turns", "text")).alias("longest"), told.alias("told"), F.sum(F.length("text")).cast("long").alias("formatted_chars"))
    loss = F.array_join(F.transform("told", lambda x: x["t"]), "")
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.withColumn("turns", chat.parse_turns(F.col("longest.text"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints_with_next(table(spark, sf_dir, "documents"))


def op8_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_block_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mixing.mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy(F.col("id").alias("p_id"), F.col("t").alias("p_t"), F.col("start").alias("p_start")).agg(F.sum("n_words").alias("taken"))
    out = documents.join(taken, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("t") == F.col("p_t")) & (F.col("start") == F.col("p_start")) & (F.col("size") > 0), "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op11_queue_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), bpe.load_vocabulary(tokenizer_path()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_distinct_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_rank_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    hurt = turn_repair.damage(turns)
    repaired = turn_repair.repair(hurt)
    written = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    is_fault = lambda k: F.when(F.col("fault") == k, F.lit(1)).otherwise(F.lit(0))
    more = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(0)).otherwise(F.col("copies") - 1)  # copies behind the first
    counts = {"blank": is_fault("blank") * F.col("copies"), "duplicate": is_fault("duplicate") * F.col("copies") + more, "truncated": is_fault("truncated"), "illegal": F.col("illegal"), "cost": F.col("cost")}
    piece = F.struct("pos", "edits", written.alias("written"))
    rows = repaired.select("conv_id", *[v.cast("long").alias(k) for k, v in counts.items()], F.lit(None).cast("long").alias("gaps"), piece.alias("piece"))
    seen = hurt.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    known = turns.select("conv_id").distinct().withColumn("gaps", F.lit(0).cast("long"))
    both = rows.unionByName(seen.unionByName(known), allowMissingColumns=True)  # a conversation of which no row is left has zeros
    whole = both.groupBy("conv_id").agg(F.max("gaps").alias("gaps"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counts], F.sort_array(F.collect_list("piece")).alias("pieces"))
    audit = F.array_join(F.transform("pieces", lambda p: p["edits"]), "")
    text = F.array_join(F.flatten(F.transform("pieces", lambda p: p["written"])), "\n")
    return whole.select("conv_id", "gaps", *counts, audit.alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))


NAMED = (
    op1_attention_quality, op2_line_frequency, op3_warc_transactions, op4_line_runs, op5_bpe_automaton, op6_prefix_targets, op7_simhash,
    op8_language_codes, op9_chosen_path, op10_block_mixture, op11_queue_packing, op12_distinct_index, op13_rank_dp,
)


def queries() -> dict:
    found = {f.__name__: f for f in NAMED}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
