"""Classification metrics from counts; no rows reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _over(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_stats(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts and statistics with class 1 as the positive one."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    out = df.agg(
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
        F.count_if(~a & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    out = out.withColumns(
        {
            "accuracy": _over(tp + tn, n),
            "precision": _over(tp, tp + fp),
            "recall": _over(tp, tp + fn),
            "f1": _over(2 * tp, 2 * tp + fp + fn),
            "specificity": _over(tn, tn + fp),
            "negative_predictive_value": _over(tn, tn + fn),
            "prevalence": _over(tp + fn, n),
            "detection_rate": _over(tp, n),
            "detection_prevalence": _over(tp + fp, n),
        }
    )
    out = out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / F.lit(2.0))
    expected = _over((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return out.withColumn(
        "kappa", F.try_divide(F.col("accuracy") - expected, F.lit(1.0) - expected)
    )


def multilabel_metrics(
    df: DataFrame, truths: Sequence[str], scores: Sequence[str], threshold: float = 0.5
) -> DataFrame:
    """Micro-averaged F1, precision and recall, and exact-match accuracy.

    A score counts as positive strictly above the threshold.
    """
    tp = fp = fn = F.lit(0)
    exact = F.lit(True)
    for t, s in zip(truths, scores):
        truth, said = F.col(t) == 1, F.col(s) > threshold
        tp = tp + (truth & said).cast("int")
        fp = fp + (~truth & said).cast("int")
        fn = fn + (truth & ~said).cast("int")
        exact = exact & (truth == said)
    sums = df.agg(
        F.sum(tp).alias("tp"),
        F.sum(fp).alias("fp"),
        F.sum(fn).alias("fn"),
        F.count_if(exact).alias("exact"),
        F.count(F.lit(1)).alias("total"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "tp",
        "fp",
        "fn",
        _over(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _over(tp, tp + fp).alias("precision"),
        _over(tp, tp + fn).alias("recall"),
        _over(F.col("exact"), F.col("total")).alias("accuracy"),
    )
