"""Final decisions: a point prediction, and apart from it whether independent answers verify it.

A frame has one row for each case, with what was asked and answered of its root as columns. An answer counts as sure from a
probability on; a null answer is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The widths that a finalist's excerpt is offered in, widest first.
WIDTHS = (1800, 900, 300, 80)


def ladder(finalists: DataFrame, case: str, size: str, frame: int, budget: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(case, n_candidates, width): the first width at which a case's finalists, `frame` bytes more each, fit the budget; the last one if none."""
    sums = finalists.groupBy(case).agg(F.count("*").alias("n_candidates"), *[F.sum(F.least(F.col(size), F.lit(w)) + frame).alias(f"w{w}") for w in widths])
    return sums.select(case, "n_candidates", F.coalesce(*[F.when(F.col(f"w{w}") <= budget, F.lit(w)) for w in widths], F.lit(widths[-1])).alias("width"))


def sure(choice: str, p: str, option: str, least: float) -> Column:
    """Whether the answer is that option, surely."""
    return F.coalesce((F.col(choice) == option) & (F.col(p) >= least), F.lit(False))


def joint_verdict(least: float, checks: tuple[str, ...] = ("upstream", "repair", "challenge")) -> tuple[Column, Column, Column]:
    """(refuted, supported, reason) of one question about the root's support, with the relations that its checks established.

    Columns: support, support_p, cited_step, root, attempted (array), relations (all of them sure).
    """
    tried = reduce(Column.__and__, [F.array_contains("attempted", c) for c in checks])
    direct = F.coalesce(F.col("cited_step") == F.col("root"), F.lit(False))
    holds = sure("support", "support_p", "supported", least) & direct & F.coalesce(tried & F.col("relations"), F.lit(False))
    return sure("support", "support_p", "refuted", least), holds, F.lit("retrieved_evidence_checked")


def factored_verdict(least: float) -> tuple[Column, Column, Column]:
    """(refuted, supported, reason) of independent questions about the root's origin and outcome, asked of fresh evidence.

    Columns: origin, origin_p, outcome, outcome_p, cited_step, root. One sure answer against the root refutes it; both for it, with a
    citation of the root's own step, support it.
    """
    against = sure("origin", "origin_p", "no_violation", least) | sure("outcome", "outcome_p", "repaired", least) | sure("outcome", "outcome_p", "unlinked", least)
    direct = F.coalesce(F.col("cited_step") == F.col("root"), F.lit(False))
    return against, sure("origin", "origin_p", "local", least) & sure("outcome", "outcome_p", "persists", least) & direct, F.lit("fresh_origin_and_outcome_checked")


def decide(asked: DataFrame, verdict: tuple[Column, Column, Column], case: str = "conv_id", least: float = 0.8) -> DataFrame:
    """(case, predicted_step, predicted_role, verified_step, verified_role, decision_status, decision_reason).

    asked: case, n_candidates, root (null: unknown), root_p, verified (whether the check could be asked), role, role_p, role_cited, and the
    verdict's columns. The point stands unless it is refuted; it is verified only if it is sure itself and supported.
    """
    refuted, supported, reason = verdict
    none, open_root, checked = F.coalesce(F.col("n_candidates"), F.lit(0)) == 0, F.col("root").isNull(), F.coalesce("verified", F.lit(False))
    gone = none | open_root | (checked & refuted)
    holds = ~gone & checked & supported & F.coalesce(F.col("root_p") >= least, F.lit(False))
    whose = holds & F.coalesce((F.col("role_p") >= least) & F.col("role_cited"), F.lit(False))
    status = F.when(gone, "abstained").when(holds, "supported").otherwise("best_effort")
    why = F.when(none, "no_inspected_viable_candidate").when(open_root, "no_final_candidate").when(~checked, "verification_budget_exhausted").when(refuted, "independent_evidence_refuted").when(holds, reason).otherwise("point_prediction_unverified")
    return asked.select(
        case, F.when(~gone, F.col("root")).alias("predicted_step"), F.when(~gone & checked, F.col("role")).alias("predicted_role"), F.when(holds, F.col("root")).alias("verified_step"),
        F.when(whose, F.col("role")).alias("verified_role"), status.alias("decision_status"), why.alias("decision_reason"),
    )
