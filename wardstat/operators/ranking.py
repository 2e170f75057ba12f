"""Ranking quality of a score against 0/1 labels, as DataFrame steps.

The scores are grouped first (one row per distinct score with its positives
and negatives), so tied scores are one row and a model with few distinct
scores leaves little to sort.  What is left is sorted by range partitions with
running totals split over them (``windows.running_totals``): neither a window
nor a task sees all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import running_totals

_WHOLE = "decimal(18,0)"


def by_score(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``score``, ``positives`` and ``negatives`` of every distinct score.
    Rows without a score or a label are left out; a label above 0.5 is
    positive."""
    scored = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    positive = F.col(label) > F.lit(0.5)
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.count(F.when(positive, 1)).alias("positives"), F.count(F.when(~positive, 1)).alias("negatives"))


def roc_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score taken as a threshold: ``true_positives`` and
    ``false_positives`` among the rows that score at least that much, and the
    two rates (NULL where there is no positive, or no negative)."""
    points = by_score(df, score, label)
    above = running_totals(points, [F.desc("score")], {"tp": "positives", "fp": "negatives"})
    all_of = lambda c: points.agg(F.sum(c).cast("double")).scalar()
    tp, fp = F.col("tp") + F.col("positives"), F.col("fp") + F.col("negatives")
    return above.select(
        "score", tp.alias("true_positives"), fp.alias("false_positives"),
        F.try_divide(tp.cast("double"), all_of("positives")).alias("true_positive_rate"),
        F.try_divide(fp.cast("double"), all_of("negatives")).alias("false_positive_rate"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: ``positives``, ``negatives`` and ``auc``, the exact share of
    (positive, negative) pairs in which the positive scores higher, ties
    counted half.  ``auc`` is NULL without a positive or without a negative.

    Twice the number of won pairs is a whole number, summed as a decimal, so
    the result depends neither on the order of the rows nor on their layout.
    """
    points = running_totals(by_score(df, score, label), ["score"], {"below": "negatives"})
    won = F.col("positives").cast(_WHOLE) * (2 * F.col("below") + F.col("negatives")).cast(_WHOLE)
    sums = points.agg(F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
                      F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"),
                      F.sum(won).cast("double").alias("won"))
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return sums.select("positives", "negatives", F.try_divide(F.col("won"), 2 * pairs).alias("auc"))
