"""Rounds of correcting labels.

Corrections are kept as versions (key, round, corrected): a later round may
correct a row again.  Labels can be read as of any round, their accuracy
followed over the rounds, the terms behind the errors named, and the next rows
to code chosen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(corrections: DataFrame, key: str, until: int | None = None) -> DataFrame:
    """One row per key: its last correction up to a round; equal rounds fall by label."""
    kept = corrections.where(F.col(key).isNotNull() & F.col("corrected").isNotNull() & F.col("round").isNotNull())
    if until is not None:
        kept = kept.where(F.col("round") <= until)
    return kept.groupBy(key).agg(F.max(F.struct("round", "corrected"))["corrected"].alias("corrected"))


def labels_as_of(events: DataFrame, corrections: DataFrame, key: str, label: str, until: int | None = None) -> DataFrame:
    """``events`` with ``label`` as it stood after a round."""
    joined = events.join(latest(corrections, key, until), key, "left")
    return joined.withColumn(label, F.coalesce("corrected", label)).drop("corrected")


def accuracy_by_round(events: DataFrame, corrections: DataFrame, key: str, label: str, truth: str) -> DataFrame:
    """round, n, right, accuracy after each round that corrected something; round 0 is before all.

    A correction counts from its round until the key's next one, so each
    version is one change of the number of right labels.  Changes are summed
    per round before the rounds, which are few, are added up in order.  Rows
    without truth are not counted.
    """
    coded = events.where(F.col(truth).isNotNull()).select(key, F.col(label).alias("was"), F.col(truth).alias("is"))
    versions = corrections.where(F.col("corrected").isNotNull() & F.col("round").isNotNull())
    versions = versions.groupBy(key, "round").agg(F.max("corrected").alias("corrected"))
    right = F.coalesce(F.col("corrected") == F.col("is"), F.lit(False)).cast("long")
    before = F.coalesce(F.lag("right").over(W.partitionBy(key).orderBy("round")), F.coalesce(F.col("was") == F.col("is"), F.lit(False)).cast("long"))
    met = versions.join(coded, key).withColumn("right", right)
    changes = met.withColumn("change", F.col("right") - before).groupBy("round").agg(F.sum("change").alias("change"))
    start = coded.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was") == F.col("is")).alias("first"))
    rounds = changes.select(F.col("round").cast("long").alias("round"), "change").unionByName(changes.sparkSession.createDataFrame([(0, 0)], "round long, change long"))
    summed = rounds.groupBy("round").agg(F.sum("change").alias("change"))
    running = summed.withColumn("gain", F.sum("change").over(W.orderBy("round")))  # one row a round
    out = running.withColumns({"n": start.select("n").scalar(), "right": F.col("gain") + start.select("first").scalar()})
    return out.select("round", "n", "right", F.try_divide(F.col("right").cast("double"), F.col("n").cast("double")).alias("accuracy"))


def error_terms(words: DataFrame, wrong: DataFrame, key: str, k: int = 20, least: int = 5, term: str = "word") -> DataFrame:
    """Terms over-represented among errors: n_wrong, n_right (rows with the term), log_odds; the k largest, ties by term.

    ``words``: key and term; ``wrong``: key and wrong (boolean), one row per
    key.  Log odds are of a row being wrong with the term against without it,
    half a row added to each of the four counts.  Terms of fewer than ``least``
    rows are left out.
    """
    told = words.select(key, term).distinct().join(wrong.select(key, "wrong"), key)
    counts = told.groupBy(term).agg(F.count_if("wrong").alias("n_wrong"), F.count_if(~F.col("wrong")).alias("n_right"))
    totals = wrong.agg(F.count_if("wrong").alias("w"), F.count_if(~F.col("wrong")).alias("r"))
    w, r = totals.select("w").scalar(), totals.select("r").scalar()
    half = F.lit(0.5)
    inside = F.log((F.col("n_wrong") + half) / (F.col("n_right") + half))
    outside = F.log((w - F.col("n_wrong") + half) / (r - F.col("n_right") + half))
    scored = counts.where(F.col("n_wrong") + F.col("n_right") >= least).withColumn("log_odds", F.round(inside - outside, 6))
    return scored.orderBy(F.desc("log_odds"), term).limit(k)


def next_to_code(events: DataFrame, corrections: DataFrame, key: str, stratum: Sequence[str], score: str, per_stratum: int) -> DataFrame:
    """The rows of each stratum whose score is least certain (nearest 0.5) and that nobody coded yet.

    Ties by key.  The rank filter cuts each stratum before the shuffle.
    """
    fresh = events.where(F.col(score).isNotNull()).join(corrections.select(key).distinct(), key, "left_anti")
    doubt = fresh.withColumn("doubt", F.round(1 - 2 * F.abs(F.col(score) - 0.5), 6))
    order = W.partitionBy(*stratum).orderBy(F.desc("doubt"), key)
    return doubt.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_stratum)
