"""Reading the tables and drawing bounded labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallylens.storage import landed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % parts


def held_out(parts: int, part: int, doc_id: str = "doc_id") -> Column:
    """Whether an id is in the held-out fold; false for a null id."""
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def bounded_ids(labelled: DataFrame, label: str, per_label: int, spare: int = 8) -> DataFrame:
    """At most ``per_label`` ids for each value of ``label``, drawn by hash order.

    ``labelled``: doc_id and the label.  Ids and labels that are null are left
    out, an id with several labels gets the largest.  Labels are counted first;
    a hash threshold then leaves about ``spare`` times the wanted rows of each,
    so a label with most of the rows sends no more than others to be ranked.
    """
    ids = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max(label).alias(label))
    counts = landed(ids.groupBy(label).agg(F.count("*").alias("_rows")), "label_counts")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    near = ids.join(counts, label).where(place * F.col("_rows") < spare * per_label)
    order = W.partitionBy(label).orderBy(place, "doc_id")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).select("doc_id", label)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a bounded list of ids with the label columns of ``ids``.

    ``ids`` is bounded by the sample size, so it is broadcast and the texts are
    not shuffled; of repeated ids one row stays.
    """
    label = [c for c in ids.columns if c != "doc_id"]
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.dropDuplicates(["doc_id"]).select("doc_id", "text", *label)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of whole texts that one Arrow batch holds in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def text_key(text: str = "text"):
    """Hash of a text, the same for null on every row; with the id it names a row's content."""
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
