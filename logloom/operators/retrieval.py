"""Lexical retrieval: term statistics, BM25, reciprocal-rank fusion, overlap and diversity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REPAIR, evidence_terms, jaccard, normalize_role, recipient, terms, tokens
from ..functions.workers import dealt_once, kept_once

K1, B, RRF_K, MMR = 1.2, 0.75, 60, 0.7
#: How many scores of (query, ref) a task sums at a time, at most.
PAIRS = 1_000_000


def term_frequencies(corpus: DataFrame, ref: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """(ref, term, tf), of the wanted terms if they are given."""
    each = corpus.select(ref, F.explode(tokens(F.col(text))).alias("term"))
    return (each if wanted is None else each.join(wanted, "term")).groupBy(ref, "term").agg(F.count("*").alias("tf"))


def bm25(corpus: DataFrame, queries: DataFrame, ref: str, text: str, query: str, query_text: str) -> DataFrame:
    """(query, ref, score, rank) of every positive score; queries count each term once; ranks by (score to 6 digits desc, ref)."""
    asked = queries.select(query, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")).distinct()
    lengths = corpus.select(ref, F.size(tokens(F.col(text))).cast("double").alias("len"))
    facts = lengths.agg(F.count("*").cast("double").alias("n_docs"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len"))
    # only terms that a query asks for are counted, and dealt out; the asked terms are few beside the corpus
    tf = term_frequencies(corpus, ref, text, asked.select("term").distinct())
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    part = F.ln(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1.0 - B + B * F.col("len") / F.col("avg_len")))
    weighed = tf.join(df, "term").join(lengths, ref).join(F.broadcast(facts)).select(ref, "term", part.alias("part"))
    scored = weighed.join(asked, "term").groupBy(query, ref).agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), ref)))


def fuse_scores(rankings: DataFrame, by: list[str], ref: str, rank: str, source: str) -> DataFrame:
    best = rankings.groupBy(*by, source, ref).agg(F.min(rank).alias("__r"))
    return best.groupBy(*by, ref).agg(F.round(F.sum(1.0 / (RRF_K + F.col("__r"))), 9).alias("score"))


def fuse(rankings: DataFrame, by: list[str], ref: str, rank: str = "rank", source: str = "source") -> DataFrame:
    """Reciprocal-rank fusion; a ref counts once in a ranking, at its best rank."""
    fused = fuse_scores(rankings, by, ref, rank, source)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), ref)))


def overlap_idf(corpus: DataFrame, queries: DataFrame, ref: str, text: str, query: str, query_text: str) -> DataFrame:
    """(query, ref, score, rank): summed idf ln(1 + N / df) of the shared terms.

    A ref's terms stay in one row, so a frequent term's refs never meet: a score is summed where its ref lies, and of a query's
    ranking each task gives what is asked of it. The queries' terms with their idf are met as one table, as small as the queries.
    """
    asked = kept_once(queries.select(query, F.explode(terms(F.col(query_text))).alias("term")))
    own = corpus.select(ref, F.explode(terms(F.col(text))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    n = corpus.agg(F.count("*").cast("double").alias("n_docs"))
    idf = own.groupBy("term").agg(F.count("*").cast("double").alias("df")).join(F.broadcast(n)).select("term", F.ln(1.0 + F.col("n_docs") / F.col("df")).alias("idf"))
    weighed = kept_once(asked.join(idf, "term"))
    # a task holds the pairs of its refs and the queries while it sums them: more refs make more tasks, not larger ones
    least = math.ceil(corpus.count() * queries.count() / PAIRS)
    scored = dealt_once(own, [ref], least).join(weighed, "term").groupBy(query, ref).agg(F.round(F.sum("idf"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), ref)))


def distinct_rankings(rankings: DataFrame, query: str, ref: str, rank: str = "rank") -> DataFrame:
    """Of queries with the same ranking only the smallest stays; a query without rows has no ranking."""
    row = [F.xxhash64(rank, ref), F.xxhash64(F.lit("second"), rank, ref)]
    names = rankings.groupBy(query).agg(F.count("*").alias("n"), *[F.bit_xor(h).alias(f"h{k}") for k, h in enumerate(row)])
    return rankings.join(names.groupBy("n", "h0", "h1").agg(F.min(query).alias(query)).select(query), query, "left_semi")


def fuse_whole(rankings: DataFrame, eligible: DataFrame, ref: str, query: str, rank: str = "rank", once: bool = False) -> DataFrame:
    """(ref, score, rank): reciprocal-rank fusion of complete rankings, equal ones once; without any, every eligible ref has score 1.

    once: no ranking holds a ref twice, which needs no look for its best rank then.
    Ranks come from the sizes of score bands, at most some 10,000 of any corpus, and the order within a band.
    """
    own = distinct_rankings(rankings, query, ref, rank)
    fused = own.groupBy(ref).agg(F.round(F.sum(1.0 / (RRF_K + F.col(rank))), 9).alias("score")) if once else fuse_scores(own, [], ref, rank, query)
    return ranked_fused(fused, eligible, ref)


def ranked_fused(fused: DataFrame, eligible: DataFrame, ref: str) -> DataFrame:
    """fused (ref, score) with ranks, by score, then ref; where there is none, every eligible ref has score 1."""
    fused = fused.unionByName(eligible.select(ref, F.lit(1.0).alias("score")).distinct().join(F.broadcast(fused.select(F.lit(1).alias("any")).limit(1)), F.lit(True), "left_anti"))
    banded = fused.withColumn("band", F.floor(F.ln(F.greatest("score", F.lit(1e-9))) * -800))
    ahead = F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    before = banded.groupBy("band").agg(F.count("*").alias("n")).select("band", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("band").orderBy(F.col("score").desc(), ref))
    return banded.withColumn("within", within).join(F.broadcast(before), "band").select(ref, "score", (F.col("ahead") + F.col("within")).alias("rank"))


def evidence(spans: DataFrame, asked: DataFrame, case: str = "conv_id", step: str = "step", name: str = "name", text: str = "text", seen: DataFrame | None = None) -> DataFrame:
    """(case, step, kind, ref, score, rank): every eligible span of a case for each step and kind that are asked.

    spans: case, step, name, ref, start_byte, text. Kind upstream takes earlier spans, repair later ones, challenge both;
    the asked step itself and (case, step, kind, ref) of `seen` are left out. Summed idf ln(1 + N / df) of the shared terms, N and df
    within the case, 12 more for an upstream span that addresses the step's role, 3 more for words of a repair.
    """
    s = spans.select(case, F.col(step).alias("at"), name, "ref", "start_byte", evidence_terms(F.col(text)).alias("ts"), recipient(F.col(name)).alias("to"), F.col(text).rlike(REPAIR).alias("repairs"))
    own = s.select(case, "at", "ref", F.explode("ts").alias("term"))
    n = s.groupBy(case).agg(F.count("*").cast("double").alias("n"))
    idf = own.groupBy(case, "term").agg(F.count("*").alias("df")).join(n, case).select(case, "term", F.ln(1.0 + F.col("n") / F.col("df")).alias("idf"))
    wanted = asked.select(case, step).distinct().join(own.select(case, F.col("at").alias(step), "term").distinct(), [case, step]).join(idf, [case, "term"])
    shared = wanted.join(own.select(case, "term", "ref"), [case, "term"]).groupBy(case, step, "ref").agg(F.sum("idf").alias("shared"))
    role = s.groupBy(case, F.col("at").alias(step)).agg(normalize_role(F.min(name)).alias("role"))
    met = asked.select(case, step, "kind").distinct().join(role, [case, step]).join(s.drop("ts"), case).where(F.col("at") != F.col(step))
    met = met.where(~((F.col("kind") == "upstream") & (F.col("at") > F.col(step))) & ~((F.col("kind") == "repair") & (F.col("at") < F.col(step))))
    met = met if seen is None else met.join(seen.select(case, step, "kind", "ref"), [case, step, "kind", "ref"], "left_anti")
    more = F.when((F.col("kind") == "upstream") & (F.col("to") != "") & (F.col("to") == F.col("role")), 12.0).when((F.col("kind") != "upstream") & F.col("repairs"), 3.0).otherwise(0.0)
    scored = met.join(shared, [case, step, "ref"], "left").withColumn("score", F.round(F.coalesce("shared", F.lit(0.0)) + more, 6))
    w = Window.partitionBy(case, step, "kind").orderBy(F.desc("score"), F.abs(F.col("at") - F.col(step)), "start_byte", "ref")
    return scored.withColumn("rank", F.row_number().over(w)).select(case, step, "kind", "ref", "score", "rank")


def contenders(ranked: DataFrame, by: str, score: str, k: int, rank: str = "rank") -> DataFrame:
    """The rows that mmr() can choose among its first k, all others being behind one of the k best in each round.

    A likeness is at most 1, so that holds of what scores less than the k-th best by more than (1 - MMR) / MMR of the best.
    """
    w = Window.partitionBy(by)
    kth = F.coalesce(F.max(F.when(F.col(rank) == k, F.col(score))).over(w), F.min(score).over(w))
    return ranked.withColumn("__least", kth - F.max(score).over(w) * ((1 - MMR) / MMR + 1e-9)).where(F.col(score) >= F.col("__least")).drop("__least")


def mmr(ranked: DataFrame, by: str, ref: str, score: str, term_col: str, same: str, k: int) -> DataFrame:
    """Greedy diverse choice of k: MMR * score / best - (1 - MMR) * the greatest likeness to what is chosen; equal `same` is likeness 1.

    ranked may hold every scored ref. Each round is one aggregation; the choices so far, at most k for each `by`, are
    joined to the candidates.
    """
    left = kept_once(ranked.select(by, F.col(ref).alias("__ref"), F.col(score).alias("s"), F.col(same).alias("same"), F.col(term_col).alias("ts")))
    top = left.groupBy(by).agg(F.greatest(F.max("s"), F.lit(1e-12)).alias("top"))
    chosen = None
    for _ in range(k):
        met = left.join(top if chosen is None else chosen, by)
        nearest, order = F.lit(0.0), [-F.col("s"), F.col("__ref")]
        if chosen is not None:
            nearest = F.array_max(F.transform("chosen", lambda c: F.when(F.col("same").eqNullSafe(c["same"]), 1.0).otherwise(jaccard(F.col("ts"), c["ts"]))))
        order = F.struct((1 - MMR) * nearest - MMR * F.col("s") / F.col("top"), *order)
        if chosen is not None:
            order = F.when(~F.exists("chosen", lambda c: c["ref"] == F.col("__ref")), order)
        best = F.min_by(F.struct(F.col("__ref").alias("ref"), "same", "ts"), order)
        if chosen is None:
            chosen = met.groupBy(by).agg(F.first("top").alias("top"), F.array(best).alias("chosen"))
        else:
            chosen = met.groupBy(by).agg(F.first("top").alias("top"), F.array_compact(F.concat(F.first("chosen"), F.array(best))).alias("chosen"))
    return chosen.select(by, F.posexplode("chosen").alias("at", "c")).select(by, F.col("c.ref").alias(ref), (F.col("at") + 1).cast("long").alias("rank"))


__all__ = ["bm25", "evidence", "fuse", "fuse_whole", "jaccard", "mmr", "overlap_idf", "term_frequencies"]
