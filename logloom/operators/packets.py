"""Evidence packets: what a request shows of a case, all of it or what is retrieved, within a byte budget.

A case whose eligible spans all fit is shown whole, and nothing is ranked. Of the others every query ranks the spans by BM25 within
the case, complete and distinct rankings are fused, and excerpts are taken by the lazy diverse choice until one doesn't fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.workers import kept_once
from .postings import diverse, numbers
from .ranks import grouped_rank, null_safe_join
from .retrieval import RRF_K, K1, B
from .spans import excerpt_at, rarest_term, term_start


def case_scores(spans: DataFrame, asked: DataFrame, case: str, ref: str, text: str, query: str) -> DataFrame:
    """(case, query, ref, score): BM25 within each case, positive scores to nine digits. asked: (case, query, term), each term once."""
    each = spans.select(case, ref, tokens(F.col(text)).alias("ts"))
    facts = each.groupBy(case).agg(F.count("*").cast("double").alias("n_docs"), F.greatest(F.avg(F.size("ts")), F.lit(1.0)).alias("avg_len"))
    tf = each.select(case, ref, F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy(case, ref, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(case, "term").agg(F.count("*").cast("double").alias("df"))
    idf = null_safe_join(null_safe_join(asked, df, [case, "term"]), facts, [case]).select(case, query, "term", "avg_len", F.ln(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1.0 - B + B * F.col("len") / F.col("avg_len")))
    return null_safe_join(tf, idf, [case, "term"]).groupBy(case, query, ref).agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")


def fused(scores: DataFrame, eligible: DataFrame, case: str, ref: str, query: str) -> DataFrame:
    """(case, ref, score, rank, n_queries): complete rankings of a case, equal ones once, fused; without any, all eligible refs score 1."""
    ranked = kept_once(grouped_rank(scores.withColumn("__behind", -F.col("score")), [case, query], "__behind", ref).select(case, query, ref, "rank"))
    names = ranked.groupBy(case, query).agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(k), "rank", ref)).alias(f"h{k}") for k in (1, 2)])
    once = names.groupBy(case, "n", "h1", "h2").agg(F.min(query).alias(query))
    kept = null_safe_join(ranked, once.select(case, query), [case, query], "left_semi")
    summed = kept.groupBy(case, ref).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    counted = once.groupBy(case).agg(F.count("*").alias("n_queries"))
    bare = null_safe_join(eligible.select(case, ref), counted.select(case), [case], "left_anti").withColumn("score", F.lit(1.0)).withColumn("n_queries", F.lit(0).cast("long"))
    both = null_safe_join(summed, counted, [case]).unionByName(bare)
    return grouped_rank(both.withColumn("__behind", -F.col("score")), [case], "__behind", ref).drop("__behind")


def record(case_free: list[Column]) -> Column:
    """The bytes of a record in a request."""
    return F.octet_length(F.to_json(F.struct(*case_free)))


def packet(spans: DataFrame, queries: DataFrame, budget: int, excerpt: int = 650, case: str = "conv_id", ref: str = "ref", step: str = "step", name: str = "name", text: str = "content", query: str = "query", query_text: str = "text") -> DataFrame:
    """(case, strategy, place, ref, step, start_byte, end_byte, sha256, size, n_ranked, n_queries, complete): the records that a request shows, in order.

    spans: the eligible ones; ref is a whole number that rises with the span's place in the case. queries: (case, query, text). size is
    what a record takes, beside one byte that parts it from the next; two bytes open and close a packet.
    """
    whole = spans.select(case, ref, step, name, text, F.octet_length(text).alias("n_bytes"))
    full = record([F.col(step), F.col(name), F.col(text).alias("content"), F.col(ref).alias("source_ref"), F.lit(False).alias("excerpt_only")])
    sized = whole.withColumn("full", full.cast("long"))
    totals = kept_once(sized.groupBy(case).agg((F.lit(2) + F.sum(F.col("full") + 1) <= budget).alias("fits"), F.count("*").alias("n_eligible")))
    place = grouped_rank(sized.withColumn("__one", F.lit(1)), [case], "__one", ref, "place")
    shown = null_safe_join(place, totals.where("fits"), [case]).select(
        case, F.lit("all_eligible_original_text").alias("strategy"), "place", ref, step, F.lit(0).cast("long").alias("start_byte"), F.col("n_bytes").cast("long").alias("end_byte"), F.sha2(text, 256).alias("sha256"),
        F.col("full").alias("size"), F.col("n_eligible").alias("n_ranked"), F.lit(0).cast("long").alias("n_queries"), F.lit(True).alias("complete"),
    )
    left = null_safe_join(whole, totals.where("not fits"), [case])
    asked = queries.select(case, query, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")).distinct()
    ranked = kept_once(fused(case_scores(left, asked, case, ref, text, query), left, case, ref, query))
    rarest = rarest_term(left.select(case, ref, text), asked.select(case, "term"), case, ref, text)
    first, last, content = excerpt_at(F.col(text), term_start(F.col(text), F.col("term")), excerpt)
    cut = null_safe_join(left, rarest, [case, ref], "left").select("*", first.cast("long").alias("start_byte"), last.cast("long").alias("end_byte"), content.alias("__content"))
    size = record([F.col(ref).alias("source_ref"), F.col(step), F.col(name), "start_byte", "end_byte", F.sha2("__content", 256).alias("sha256"), F.col("__content").alias("content"), F.lit(True).alias("excerpt_only")])
    cards = kept_once(cut.select(case, ref, F.col(step).alias("same"), numbers(F.col(text)).alias("terms"), "start_byte", "end_byte", F.sha2("__content", 256).alias("sha256"), size.alias("size")))

    def pages(live: DataFrame | None, n: int) -> DataFrame:
        best = ranked.where(F.col("rank") <= n)
        best = best if live is None else null_safe_join(best, live, [case], "left_semi")
        return null_safe_join(best, cards, [case, ref]).select(case, ref, "score", "rank", "same", "terms", "size")

    # a record takes two bytes at least, so a packet never holds more than half its budget of them
    chosen = diverse(pages, case, ref, budget=budget, most=max(budget, 64))
    counts = ranked.groupBy(case).agg(F.count("*").alias("n_ranked"), F.max("n_queries").alias("n_queries"))
    told = null_safe_join(null_safe_join(chosen.withColumnRenamed("rank", "place"), cards, [case, ref]), counts, [case])
    told = null_safe_join(null_safe_join(told, left.select(case, ref, step, "n_eligible"), [case, ref]), chosen.groupBy(case).agg(F.count("*").alias("n_shown")), [case])
    return shown.unionByName(told.select(
        case, F.lit("global_rrf_mmr_excerpts").alias("strategy"), "place", ref, step, "start_byte", "end_byte", "sha256", F.col("size").cast("long").alias("size"), "n_ranked", "n_queries", (F.col("n_shown") == F.col("n_eligible")).alias("complete"),
    ))
