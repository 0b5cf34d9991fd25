"""Several yes/no labels scored from a text.

Two scorers: a pipeline fitted on hand-coded rows (term weights and one
logistic regression per label), and a hook that runs any batch scorer over the
partitions.  Whole texts are scored; a length limit can be asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.functions.text import is_blank, leading, or_empty
from rallylens.storage import settle

# The three severity labels.
SEVERITY_LABELS = ("coercion", "arrest", "brutality")
BatchScorer = Callable[[pd.Series], pd.DataFrame]


def label_column(c: str) -> Column:
    """Hand-coded label to 0/1: null and blank are 0, other text is an error."""
    return F.when(is_blank(c), 0).otherwise(F.col(c).cast("int"))


def prepare_labels(df: DataFrame, text: str, labels: Sequence[str]) -> DataFrame:
    """Text without nulls, integer labels, and the label vector."""
    out = df.withColumn(text, or_empty(text)).withColumns({c: label_column(c) for c in labels})
    return out.withColumn("labels", F.array(*[F.col(c).cast("double") for c in labels]))


def _text_features(text: str, features: int) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[^\p{L}\p{Nd}]+"),
            HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
            IDF(inputCol="__tf", outputCol="__features"),
        ]
    )


def _one_label(label: str) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="__features",
        labelCol=label,
        probabilityCol=f"__p_{label}",
        rawPredictionCol=f"__r_{label}",
        predictionCol=f"__y_{label}",
        maxIter=20,
        regParam=0.1,
    )


def fit_severity(
    coded: DataFrame, text: str, labels: Sequence[str] = SEVERITY_LABELS, features: int = 1 << 16
) -> PipelineModel:
    """Term weights shared by all labels, then one regression per label.

    The weighted terms are computed once for all the passes of all labels.
    """
    ready = prepare_labels(coded, text, labels)
    weights = _text_features(text, features).fit(ready)
    rows = settle(weights.transform(ready).select("__features", *labels))
    return PipelineModel([*weights.stages, *[_one_label(c).fit(rows) for c in labels]])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_severity(
    df: DataFrame,
    model: PipelineModel,
    text: str,
    labels: Sequence[str] = SEVERITY_LABELS,
    max_chars: int | None = None,
) -> DataFrame:
    """One score column per label on the same rows; blank text scores 0."""
    original = "__original"
    used = or_empty(text) if max_chars is None else leading(or_empty(text), max_chars)
    ready = df.withColumn(original, F.col(text)).withColumn(text, used)
    scored = model.transform(ready)
    blank = is_blank(text)
    scores = [
        F.when(blank, 0.0).otherwise(vector_to_array(f"__p_{c}")[1]).alias(f"{c}_score") for c in labels
    ]
    kept = [F.col(original).alias(c) if c == text else F.col(c) for c in df.columns]
    return scored.select(*kept, *scores)


def score_batches(
    df: DataFrame,
    text: str,
    scorer: BatchScorer,
    labels: Sequence[str],
    max_chars: int | None = None,
    failed: str | None = "failed",
) -> DataFrame:
    """Run ``scorer`` over Arrow batches of non-blank texts; only the text goes through Python.

    ``scorer`` maps a series of texts to a frame with one column per label.
    Blank texts score 0.  When a batch fails its texts are scored one by one,
    and a text that fails alone scores 0 and is flagged in ``failed`` (None
    leaves the flag out).
    """
    labels = list(labels)
    made = T.StructType([T.StructField(c, T.DoubleType()) for c in labels] + [T.StructField("__failed", T.BooleanType())])

    def one_by_one(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for i in range(len(texts)):
            piece = texts.iloc[i : i + 1]
            try:
                parts.append(scorer(piece)[labels].set_axis(piece.index).assign(__failed=False))
            except Exception:  # a scorer may fail in any way; that text is flagged
                parts.append(pd.DataFrame(0.0, index=piece.index, columns=labels).assign(__failed=True))
        return pd.concat(parts)

    @F.pandas_udf(made)
    def score(column: pd.Series) -> pd.DataFrame:
        texts = column.fillna("").astype(str)
        if max_chars is not None:
            texts = texts.str.slice(0, max_chars)
        texts = texts[texts.str.strip() != ""]
        scores = pd.DataFrame(0.0, index=column.index, columns=labels).assign(__failed=False)
        if len(texts):
            try:
                found = scorer(texts)[labels].set_axis(texts.index).assign(__failed=False)
            except Exception:  # see one_by_one
                found = one_by_one(texts)
            scores.loc[texts.index, labels] = found[labels].astype(float)
            scores.loc[texts.index, "__failed"] = found["__failed"]
        return scores

    scored = df.withColumn("__scores", score.asNondeterministic()(F.col(text)))
    flags = [] if failed is None else [F.col("__scores.__failed").alias(failed)]
    return scored.select(*df.columns, *[F.col("__scores")[c].alias(c) for c in labels], *flags)
