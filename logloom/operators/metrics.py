"""Scoring of root-cause predictions and its aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_role

NEAR = 5


def score_rows(gold: DataFrame, predictions: DataFrame, case: str = "conv_id") -> DataFrame:
    """Every labelled case, scored; one without a prediction is wrong throughout and has no error.

    gold: case, n_steps, mistake_step, mistake_agent. predictions: case, predicted_step, predicted_role.
    """
    j = gold.join(predictions, case, "left")
    valid = F.coalesce(F.col("predicted_step").between(0, F.col("n_steps") - 1), F.lit(False))
    err = F.when(valid, F.abs(F.col("predicted_step") - F.col("mistake_step")))
    return j.select(
        "*", valid.alias("step_valid"), F.coalesce(normalize_role(F.col("predicted_role")) == normalize_role(F.col("mistake_agent")), F.lit(False)).alias("role_correct"),
        F.coalesce(valid & (err == 0), F.lit(False)).alias("step_exact"), F.coalesce(valid & (err <= NEAR), F.lit(False)).alias("step_near"), err.cast("long").alias("step_error"),
    )


def share(flag: Column | str) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.round(F.avg(c.cast("double")), 6)


def metric_columns() -> list[Column]:
    return [F.count("*").alias("n"), share("role_correct").alias("role"), share("step_exact").alias("exact"), share("step_near").alias("near"), F.round(F.avg(F.col("step_error").cast("double")), 6).alias("mae")]


def metrics(scored: DataFrame, *by: str) -> DataFrame:
    return (scored.groupBy(*by) if by else scored).agg(*metric_columns())


def weighted_mae(scored: DataFrame, by: str) -> DataFrame:
    """Sources weigh by their rows; null if a source has no valid prediction."""
    each = scored.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("step_error").cast("double")).alias("mae"))
    return each.agg(F.when(F.count_if(F.col("mae").isNull()) == 0, F.round(F.sum(F.col("n") * F.col("mae")) / F.sum("n"), 6)).alias("weighted_mae"))


def loss_stage(recalled: Column, reduced: Column, exact: Column, direct: Column) -> Column:
    return F.when(exact, "correct").when(direct, "direct_wrong").when(~recalled, "recall_miss").when(~reduced, "reduction_drop").otherwise("final_wrong")
