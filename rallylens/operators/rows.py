"""Row filters and unions whose null rules differ from plain SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Drop rows with a listed value; rows without a value stay."""
    return df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def with_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither null nor empty."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that a filter on them does not compute again.

    A filter on a plain computed column is pushed below it and carries the
    whole expression along.  A generator of one row stops that, and needs no
    shuffle and no copy of the table.
    """
    kept = df.drop(*columns)
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return kept.select("*", F.inline(F.array(made)))


def stack_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; the columns must agree."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def stack_tagged(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union with a source tag; columns a table lacks become null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
