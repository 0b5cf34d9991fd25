"""The same labels on newly landed files.

Collection is repeated from time to time; each run may read only the new
pages.  All rules used here look at one row, so the stream keeps no state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rallylens.operators.actors import event_partisanship, inline_field_flags
from rallylens.rules.decisions import police_presence
from rallylens.rules.packs import LabelRule
from rallylens.sources.incidents import EVENT_SCHEMA


def landed_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def classify(events: DataFrame, rules: Sequence[LabelRule]) -> DataFrame:
    """Flags, event type and police presence; static or streaming input."""
    return police_presence(event_partisanship(inline_field_flags(events, rules)))


def classify_new_files(
    spark: SparkSession, landing: str, output: str, progress: str, rules: Sequence[LabelRule]
) -> StreamingQuery:
    """Classify all files not seen before, append them as Parquet, then stop."""
    return (
        classify(landed_stream(spark, landing), rules)
        .writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .partitionBy("country")
        .trigger(availableNow=True)
        .start(output)
    )
