"""Selection policies over fixed-choice answers: (question, option, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import null_safe_join, value_at_ranks


def top_k_forced(answers: DataFrame, k: int, question: str = "question", option: str = "option", choice: str = "choice") -> DataFrame:
    """The k best options, the chosen one first, then by (p desc, option); a missing p counts as 0."""
    w = Window.partitionBy(question).orderBy((F.col(option) == F.col(choice)).desc_nulls_last(), F.coalesce("p", F.lit(0.0)).desc(), F.col(option))
    return answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_choices(answers: DataFrame, named: Column, k: int, question: str = "question") -> DataFrame:
    """(question, option, rank): the k best of the options that name something, by (p desc, option), the chosen one first if it does.

    A choice that names nothing, unknown say, promotes none. A missing p counts as 0; a question with a p that is no number from 0 to 1 is
    left out as a whole.
    """
    sane = F.coalesce("p", F.lit(0.0)).between(0.0, 1.0) & ~F.isnan(F.coalesce("p", F.lit(0.0)))
    checked = answers.withColumn("__sane", F.bool_and(sane).over(Window.partitionBy(question))).where(F.col("__sane") & named)
    order = Window.partitionBy(question).orderBy((F.col("option") == F.col("choice")).desc_nulls_last(), F.coalesce("p", F.lit(0.0)).desc(), "option")
    return checked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(question, "option", "rank")


def adaptive_set(answers: DataFrame, mass: float | str = 0.9, question: str = "question") -> DataFrame:
    """The fewest likeliest options that reach the mass, with all ties of the last; mass 1 keeps all.

    mass may name a column. An option stays if the options strictly likelier than it fall short of the mass.
    """
    goal = F.col(mass) if isinstance(mass, str) else F.lit(float(mass))
    above = F.sum("p").over(Window.partitionBy(question).orderBy(F.col("p").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("p").over(Window.partitionBy(question, "p"))
    return answers.withColumn("__above", above).where((goal >= 1.0) | (F.col("__above") < goal - F.lit(1e-12))).drop("__above")


def valid_distributions(answers: DataFrame, question: str = "question") -> DataFrame:
    """(question, valid): finite p in [0, 1], options once each, a sum within 0.025 of 1."""
    ok = F.col("p").isNotNull() & ~F.isnan("p") & F.col("p").between(0.0, 1.0)
    return answers.groupBy(question).agg((F.min(ok.cast("int")) == 1).alias("sane"), (F.count("*") == F.countDistinct("option")).alias("once"), F.sum("p").alias("total")).select(question, (F.col("sane") & F.col("once") & (F.abs(F.col("total") - 1.0) <= 0.025)).alias("valid"))


def judge_answers(offered: DataFrame, answers: DataFrame, question: str = "question") -> DataFrame:
    """(question, verdict) of every question that was asked: options (not the offered ones, each once), choice (not offered), probability (null or outside 0 to 1), sum, or ok."""
    told = answers.select(question, "option", "p", "choice", F.lit(1).alias("__told"))
    j = offered.select(question, "option", F.lit(1).alias("__asked")).join(told, [question, "option"], "full")
    same = F.col("__told").isNotNull() & F.col("__asked").isNotNull()
    sane = F.coalesce(F.col("p").between(0.0, 1.0) & ~F.isnan("p"), F.lit(False))
    g = j.groupBy(question).agg((F.bool_and(same) & (F.count("*") == F.countDistinct("option"))).alias("same"), F.bool_or(F.col("option") == F.col("choice")).alias("listed"), F.bool_and(sane).alias("sane"), F.sum("p").alias("total"), F.max("__asked").alias("asked"))
    verdict = F.when(~F.col("same"), "options").when(~F.coalesce("listed", F.lit(False)), "choice").when(~F.col("sane"), "probability").when(F.abs(F.col("total") - 1.0) > 0.025, "sum").otherwise("ok")
    return g.where("asked is not null").select(question, verdict.alias("verdict"))


def entropy_argmax(answers: DataFrame, question: str = "question") -> DataFrame:
    """(question, n_options, best, best_p, entropy): entropy over its maximum; 0 with one option."""
    w = Window.partitionBy(question).orderBy(F.col("p").desc(), "option")
    top = answers.withColumn("__r", F.row_number().over(w))
    term = F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(F.lit(0.0))
    return top.groupBy(question).agg(
        F.count("*").alias("n_options"), F.max(F.when(F.col("__r") == 1, F.col("option"))).alias("best"), F.max("p").alias("best_p"),
        F.when(F.count("*") == 1, F.lit(0.0)).otherwise(-F.sum(term) / F.ln(F.count("*").cast("double"))).alias("entropy"),
    )


def conformal_calibration(answers: DataFrame, truth: DataFrame, alpha: float = 0.1, question: str = "question", kind: str = "kind") -> DataFrame:
    """Per kind: n, mass, top1_accuracy, mean_max_probability, brier. truth has (question, kind, truth)."""
    a = answers.join(truth, question)
    p_true = F.max(F.when(F.col("option") == F.col("truth"), F.col("p"))).over(Window.partitionBy(question))
    a = a.withColumn("__t", F.coalesce(p_true, F.lit(0.0)))
    w = Window.partitionBy(question).orderBy(F.col("p").desc(), "option")
    each = a.withColumn("__r", F.row_number().over(w)).groupBy(kind, question).agg(
        F.least(F.lit(1.0), F.sum(F.when(F.col("p") >= F.col("__t"), F.col("p")).otherwise(F.lit(0.0)))).alias("s"),
        F.max(F.when((F.col("__r") == 1) & (F.col("option") == F.col("truth")), 1.0).otherwise(0.0)).alias("hit"), F.max("p").alias("top"),
        F.sum(F.pow(F.col("p") - F.when(F.col("option") == F.col("truth"), 1.0).otherwise(0.0), F.lit(2.0))).alias("b"),
    )
    # a few kinds hold all questions: the quantile is found by counting, not by sorting a kind
    mass = value_at_ranks(each, [kind], "s", {"mass": lambda n: F.ceil((n + 1) * F.lit(1.0 - alpha))}).select(kind, F.coalesce("mass", F.lit(1.0)).alias("mass"))
    means = each.groupBy(kind).agg(F.count("*").alias("n"), F.avg("hit").alias("top1_accuracy"), F.avg("top").alias("mean_max_probability"), F.avg("b").alias("brier"))
    return null_safe_join(means, mass, [kind]).select(kind, "n", "mass", "top1_accuracy", "mean_max_probability", "brier")
