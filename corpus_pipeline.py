"""From raw documents to packed sequences: language, near-duplicates, benchmark passages, personal data, packing.

Every stage works on all that its predecessor kept and returns the columns of
documents; the last returns the packed pieces.  Null and empty texts have no
letter and end at the first stage; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallylens.llm import decontaminate, langid, packing, pii, registry, similar
from rallylens.llm.tables import small_batches, table, unused
from rallylens.storage import landed

#: The first stages are learnt models and hashes that SQL has no words for.
ORACLE_SQL = None

#: Of four languages, one below this score has no evidence: they share 1 evenly at 0.25.
LEAST_SCORE = 0.3


def least_score(languages: int) -> float:
    """The score at which a language outweighs the mean of the others as ``LEAST_SCORE`` does among four."""
    best, other = LEAST_SCORE * 3, (1 - LEAST_SCORE) * (languages - 1)
    return best / (best + other)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised, and say which it is."""
    small_batches(spark)
    found = unused(docs, "told")
    model = registry.language_model(docs)
    told = docs.withColumn(found, langid.language("text", model))
    kept = told.where((F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.score") >= least_score(max(1, len(model.langs)))))
    return kept.withColumn("lang", F.col(f"{found}.lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles of similarity 0.8 or more."""
    small_batches(spark)
    return similar.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts and count their characters anew."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, registry.vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each landed before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
