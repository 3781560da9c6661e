"""Bounded iterative operators: tournaments, and budgets over a call log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import kept_once
from .ranks import null_safe_join, range_rank
from .segment import greedy_pack


def _beaten(placed: DataFrame, by: str, item: str, score: str, group: int) -> DataFrame:
    """placed with __g, the group of its place __at in its case, and __r, its rank there: a group meets in a task, a case never does."""
    grouped = placed.withColumn("__g", F.floor((F.col("__at") - 1) / group))
    return grouped.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__g").orderBy(F.col(score).desc(), item, "__at")))


def _placed(candidates: DataFrame, by: str, item: str, score: str) -> DataFrame:
    """candidates with __at, the 1-based place of each in its case, by item; of equal items the best comes first."""
    told = candidates.withColumn("__tie", F.monotonically_increasing_id())
    return range_rank(told, [by], [F.asc(item), F.desc(score), F.asc("__tie")], "__at").drop("__tie")


def tournament_round(candidates: DataFrame, by: str, item: str, score: str, group: int = 8, keep: int = 3) -> DataFrame:
    """Candidates in order fall into groups; the best of each go on. Groups of at most keep pass whole."""
    ranked = _beaten(_placed(candidates, by, item, score), by, item, score, group)
    return ranked.where(F.col("__r") <= keep).drop("__at", "__g", "__r")


def tournament(candidates: DataFrame, by: str, item: str, score: str, limit: int = 8, group: int = 8, keep: int = 3, largest: int | None = None) -> DataFrame:
    """Rounds until no case has more than limit candidates; the number of rounds follows from the largest case alone.

    Cases already within the limit aren't reduced further. Candidates are sorted once: all groups but a case's last send on as many,
    so the survivors' places in the next round and their number follow by arithmetic, and a round is one shuffle of what is left.
    """
    placed = _placed(candidates, by, item, score)
    sizes = kept_once(placed.groupBy(by).agg(F.max("__at").alias("__n")))
    most = largest if largest is not None else sizes.agg(F.max("__n")).first()[0] or 0
    live, names = null_safe_join(placed, sizes, [by]), candidates.columns
    while most > limit:
        n, plays = F.col("__n"), F.col("__n") > limit
        left = _beaten(live, by, item, score, group).where((F.col("__r") <= keep) | ~plays)
        place = F.col("__g") * keep + F.row_number().over(Window.partitionBy(by, "__g").orderBy("__at"))
        size = F.floor(n / group) * keep + F.least(n % group, F.lit(keep))
        live = left.select(*names, F.when(plays, place).otherwise(F.col("__at")).alias("__at"), F.when(plays, size).otherwise(n).alias("__n"))
        most = most // group * keep + min(most % group, keep)
    return live.select(*names)


def adaptive_tournament(candidates: DataFrame, by: str, item: str, score: str, size: str, unsure: str, budget: int, percent: int = 90, most: int = 250, rounds: int = 30) -> DataFrame:
    """(by, item, status): groups packed to a context keep their mass sets, until a case's candidates fit one group.

    A group whose mass set holds an unsure candidate keeps all. status is final (one group), final_context_ambiguity (a round
    took nothing away, so the case abstains) or round_limit. All cases play a round at once; a round is kept, then asked
    whether any case is left.
    """
    live, done = kept_once(candidates.select(by, item, score, size, unsure)), []
    for _ in range(rounds):
        group, case = Window.partitionBy(by, "batch"), Window.partitionBy(by)
        ahead = group.orderBy(F.col(score).desc(), item).rowsBetween(Window.unboundedPreceding, -1)
        chosen = F.coalesce(F.sum(score).over(ahead), F.lit(0)) * 100 < F.sum(score).over(group) * percent
        played = greedy_pack(live, [by], [item], F.col(size), budget, most).withColumn("__in", chosen)
        played = played.withColumn("__kept", F.col("__in") | F.bool_or(F.col("__in") & F.col(unsure)).over(group))
        status = F.when(F.max("batch").over(case) == 0, "final").when(F.bool_and("__kept").over(case), "final_context_ambiguity")
        judged = kept_once(played.withColumn("status", status))
        done.append(judged.where("status is not null").select(by, item, "status"))
        live = judged.where("status is null and __kept").select(by, item, score, size, unsure)
        if live.isEmpty():
            break
    done.append(live.select(by, item, F.lit("round_limit").alias("status")))
    return reduce(DataFrame.unionByName, done)


def budget_stop(calls: DataFrame, case: str, order: list[str], tokens: str, max_calls: int, max_tokens: int, reserve_calls: int = 0, reserve_tokens: int = 0) -> DataFrame:
    """(case, stop_at, reason): the first call of each case that a budget refuses, in the order calls, tokens; null if none."""
    w = Window.partitionBy(case).orderBy(*order)
    n = F.row_number().over(w)
    used = F.coalesce(F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    why = F.when(n > max_calls - reserve_calls, F.lit("call_budget" if not reserve_calls else "reserved_final_calls")).when(used + F.col(tokens) > max_tokens - reserve_tokens, F.lit("input_token_budget" if not reserve_tokens else "reserved_final_tokens"))
    each = calls.withColumn("__n", n).withColumn("__why", why)
    return each.groupBy(case).agg(F.min(F.when(F.col("__why").isNotNull(), F.struct(F.col("__n").alias("n"), F.col("__why").alias("why")))).alias("s")).select(case, F.col("s.n").cast("long").alias("stop_at"), F.col("s.why").alias("reason"))


def session_stop(calls: DataFrame, case: str, order: list[str], size: str, tokens: str, max_calls: int, max_bytes: int, max_tokens: int, request_bytes: int) -> DataFrame:
    """(case, stop_at, reason): the first request that is refused; null if none.

    In this order: a request too large by itself, the number of calls, bytes sent with it, and tokens used before it. A null or
    negative token count is invalid usage and stops at the request after which it was reported.
    """
    w = Window.partitionBy(case).orderBy(*order)
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    n, sent = F.row_number().over(w), F.coalesce(F.sum(size).over(ahead), F.lit(0))
    used = F.coalesce(F.sum(tokens).over(ahead), F.lit(0))
    why = F.when(F.col(size) > request_bytes, "request_context_limit").when(n > max_calls, "call_budget").when(sent + F.col(size) > max_bytes, "request_byte_budget").when(used >= max_tokens, "input_token_budget").when(F.col(tokens).isNull() | (F.col(tokens) < 0), "invalid_usage")
    first = F.min(F.when(F.col("__why").isNotNull(), F.struct(F.col("__n").alias("n"), F.col("__why").alias("why"))))
    return calls.withColumn("__n", n).withColumn("__why", why).groupBy(case).agg(first.alias("s")).select(case, F.col("s.n").cast("long").alias("stop_at"), F.col("s.why").alias("reason"))
