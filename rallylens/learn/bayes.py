"""Multinomial naive Bayes over token tables.

Training is one aggregation of words per class; prediction is a lookup of the
word model and a sum per document.  Both start from tokens, so each task adds
up its own rows before anything is shuffled.  Log probabilities are kept as
whole millionths, so sums do not depend on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallylens.operators.lookup import lookup_join
from rallylens.storage import settle

MICRO = 1_000_000


def train(words: DataFrame, word: str, label: str, smooth: float = 1.0, n: str | None = None) -> DataFrame:
    """Word model: ``word, log0, log1`` in millionths, for classes 0 and 1.

    ``words`` has one row per token of the training documents, with the
    document's 0/1 label, or counted rows with their count in ``n``.  Counts
    are smoothed; both classes have equal priors.
    """
    times = F.lit(1) if n is None else F.col(n)
    per_word = settle(
        words.groupBy(word).agg(
            *[F.sum(F.when(F.col(label) == c, times).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
        )
    )
    sums = per_word.agg(
        F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count(F.lit(1)).alias("v")
    ).first()
    if not sums["v"]:
        raise ValueError("no training words")

    def log_of(n: str, total: int) -> Column:
        p = (F.col(n) + F.lit(float(smooth))) / F.lit(float(total + smooth * sums["v"]))
        return F.round(F.log(p) * F.lit(float(MICRO))).cast("long")

    return per_word.select(
        word, log_of("n0", sums["t0"]).alias("log0"), log_of("n1", sums["t1"]).alias("log1")
    )


def match_vocabulary(words: DataFrame, model: DataFrame, word: str = "word") -> DataFrame:
    """Tokens whose word is a feature of the model."""
    return lookup_join(words, model.select(word), word, "left_semi", merge=True)


def predict(words: DataFrame, model: DataFrame, documents: DataFrame, doc: str, word: str = "word") -> DataFrame:
    """Scores and class of every document.

    Words the model does not know do not count.  Equal scores, among them
    those of a document without any known word, give class 0.
    """
    scored = (
        lookup_join(words.select(doc, word), model, word, "inner", merge=True)
        .groupBy(doc)
        .agg(F.sum("log0").alias("micro0"), F.sum("log1").alias("micro1"))
    )
    out = documents.join(scored, doc, "left").na.fill(0, ["micro0", "micro1"])
    return out.withColumns(
        {
            "score0": F.col("micro0") / F.lit(float(MICRO)),
            "score1": F.col("micro1") / F.lit(float(MICRO)),
            "predicted": (F.col("micro1") > F.col("micro0")).cast("int"),
        }
    ).drop("micro0", "micro1")
