"""A lexical choice model: what a question's options score in the texts, as a distribution over the options.

It takes the place of a remote model where answers must be repeatable: columns only, so plans that ask it can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each signal in a text adds to a step's score as the cause of a failure.
WEIGHTS = {"failure": 2, "constraint": 1, "repair": -1}


def signals(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """Which of the patterns a text shows; null shows none."""
    return {k: F.coalesce(text.rlike(f"(?iu){p}"), F.lit(False)) for k, p in patterns.items()}


def suspicion(shown: dict[str, Column], overlap: Column) -> Column:
    """A step's score: its weighted signals, and an eighth for each term that it shares with the task and the outcome."""
    return sum((F.when(c, F.lit(float(WEIGHTS[k]))).otherwise(F.lit(0.0)) for k, c in shown.items()), F.lit(0.0)) + overlap / F.lit(8.0)


def distribution(options: DataFrame, question: list[str], option: str, score: str, temperature: float = 1.0) -> DataFrame:
    """options with p, to nine digits, and choice, the likeliest option; of equals the smallest. A null score counts as 0.

    A question's options meet in one task: there are as many as one request offers.
    """
    own = Window.partitionBy(*question)
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) / temperature
    raised = options.withColumn("__e", F.exp(value - F.max(value).over(own)))
    told = raised.withColumn("p", F.round(F.col("__e") / F.sum("__e").over(own), 9)).drop("__e")
    return told.withColumn("choice", F.first(option).over(own.orderBy(F.desc("p"), option).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
