"""CSV tables, landed event pages and hand-coding sheets.

Text fields may hold line breaks, so CSV is read with ``multiLine``; such a
file is one task.  The sink therefore bounds the rows per file.  Parquet is the
better format between our own steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.sources.incidents import EVENT_SCHEMA
from rallylens.storage import settle

ROWS_PER_FILE = 250_000
# Missing is written NA; empty and NA are read as missing.
MISSING = "NA"
# Label columns of a hand-coding sheet.
SHEET_LABELS = ("presence", "coercion", "arrest", "brutality")


REJECTED = "rejected_record"


def _fields(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    return spark.read.schema(schema).csv(
        path, header=True, nullValue=MISSING, multiLine=True, escape='"', quote='"', **options
    )


def _missing(df: DataFrame) -> DataFrame:
    """Empty text is missing, also when it was quoted."""
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in texts else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, schema: str | T.StructType = EVENT_SCHEMA) -> DataFrame:
    """CSV with a header; empty and NA are null.  A row that does not fit the schema is an error."""
    return _missing(_csv(spark, path, _fields(schema), mode="FAILFAST"))


def read_table_checked(
    spark: SparkSession, path: str, schema: str | T.StructType = EVENT_SCHEMA
) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and the text of those that do not."""
    fields = _fields(schema)
    marked = T.StructType([*fields.fields, T.StructField(REJECTED, T.StringType())])
    rows = _csv(spark, path, marked, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED)
    good = rows.where(F.col(REJECTED).isNull()).select(*fields.names)
    return _missing(good), settle(rows).where(F.col(REJECTED).isNotNull()).select(REJECTED)


def read_table_keep_empty(
    spark: SparkSession, path: str, schema: str | T.StructType = EVENT_SCHEMA
) -> DataFrame:
    """As ``read_table``, with missing text as empty text."""
    df = read_table(spark, path, schema)
    return df.na.fill("", [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int = ROWS_PER_FILE
) -> None:
    """CSV with a header, missing as NA, one folder per partition value."""
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(
        path,
        header=True,
        nullValue=MISSING,
        escape='"',
        quote='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def land_pages(events: DataFrame, path: str, rows_per_page: int = 10_000) -> None:
    """JSON pages below ``country=*/year=*``, as a collector leaves them."""
    events.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_page).partitionBy(
        "country", "year"
    ).json(path, ignoreNullFields=False)


def read_pages(spark: SparkSession, path: str, schema: str | T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Landed event rows; the folder names give country and year.

    All countries and years come from one scan, and a filter on either one
    prunes the folders that are read.  A broken line is an error.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def response_pages(
    spark: SparkSession, path: str, schema: str | T.StructType = EVENT_SCHEMA
) -> DataFrame:
    """Landed service responses, ``{"status": 200, "data": [events]}`` per line.

    One row per page: folder tags (``name=value``), status, data, and the line
    itself in ``rejected_record`` where it is no such response.  The pages are
    parsed once and settled.
    """
    envelope = T.StructType().add("status", T.IntegerType()).add("data", T.ArrayType(_fields(schema)))
    envelope = envelope.add(REJECTED, T.StringType())
    read = spark.read.schema(envelope)
    pages = settle(read.json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED))
    return pages.withColumn("data", F.when(F.col("status") == 200, F.col("data")))


def read_responses(
    spark: SparkSession, path: str, schema: str | T.StructType = EVENT_SCHEMA
) -> DataFrame:
    """The events of all good pages with the folder tags.

    Responses with another status carry no events; what became of the pages is
    told by ``page_report``.
    """
    pages = response_pages(spark, path, schema)
    tags = [c for c in pages.columns if c not in ("status", "data", REJECTED)]
    return pages.where(F.col("data").isNotNull()).select(*tags, F.inline("data"))


def page_report(pages: DataFrame, tags: Sequence[str], page_size: int) -> DataFrame:
    """Pages of each folder: all, failed, broken, empty, shorter than a full page, and their events."""
    n = F.coalesce(F.size("data"), F.lit(0))
    good, broken = F.col("data").isNotNull() & F.col(REJECTED).isNull(), F.col(REJECTED).isNotNull()
    return pages.groupBy(*tags).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(~broken & ~good).alias("failed"), F.count_if(broken).alias("broken"),
        F.count_if(good & (n == 0)).alias("empty"), F.count_if(good & (n > 0) & (n < page_size)).alias("short"),
        F.sum(F.when(good, n).otherwise(0)).alias("events"),
    )


def coding_sheet(events: DataFrame, keep: Sequence[str] = ("country", "event_date", "interaction", "notes")) -> DataFrame:
    """Columns to read plus label columns, all 0, to be filled in by hand."""
    return events.select(*keep, *[F.lit(0).alias(c) for c in SHEET_LABELS])
