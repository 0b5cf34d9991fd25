"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's
fractional rank is (rank + 1/2) / rows of its source.  All rows sorted by it
are an even interleaving of the sources, and equal cuts of that order are
shards with the corpus mixture and row counts at most one apart.  Both ranks
are counted in cells, so neither a source nor the whole order is gathered.

Defined results: a null text has size 1 and the checksum of no bytes; a null
source is a source of its own; equal rows are separate rows of the result; an
empty table gives no rows; extra columns are ignored.  Equal texts are not kept
together: the law is about row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallylens.llm.ranks import cells, ranked, unit
from rallylens.llm.tables import text_key
from rallylens.storage import landed


def shard(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (from 0 in each shard)."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.concat(F.when(F.col("source").isNull(), "-").otherwise("="), F.coalesce("source", F.lit(""))).alias("stratum"),
        F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(0)), text_key()).alias("h"),
    )
    rows = landed(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies")), "shard_rows")
    n = rows.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    keep = ["doc_id", "source", "size", "text_crc32"]
    sourced = ranked(rows.withColumn("u", unit(F.col("h"))), ["stratum"], F.col("u"), ["u", "h", "doc_id", "text_crc32"], cells(n))
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("group_rows"))
    mixed = sourced.select(*keep, "stratum", F.col("rank").alias("of"), fraction.alias("f"), F.lit(1).cast("long").alias("copies"), F.lit(0).alias("all"))
    placed = ranked(mixed, ["all"], F.col("f"), ["f", "stratum", "of"], cells(n))
    number = F.expr(f"rank * {shards} div greatest({n}, 1)")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", number).select(*keep, F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"))
