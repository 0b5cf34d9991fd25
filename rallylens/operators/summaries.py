"""Counts, shares, rates and cross-tabulations.

All of them aggregate before they shuffle, so the shuffled data is as large as
the number of groups, whatever the size of one group.  Totals over all groups
are scalar subqueries rather than windows over everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallylens.functions.text import is_missing, percent


def frequency(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """Count per value; null is not a value here."""
    present = df
    for c in by:
        present = present.where(F.col(c).isNotNull())
    return present.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def share(df: DataFrame, *by: str, name: str = "n", percent_name: str = "percent") -> DataFrame:
    """Count and percentage per value; null is a value here."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    total = counts.agg(F.sum(name)).scalar()
    return counts.withColumn(
        percent_name, F.col(name).cast("double") / total.cast("double") * F.lit(100.0)
    )


def share_within(
    df: DataFrame, group: Sequence[str], by: str, name: str = "n", percent_name: str = "percent"
) -> DataFrame:
    """Count and percentage of each value inside its group.

    The window runs over counts, one row per group and value, not over rows.
    """
    counts = df.groupBy(*group, by).agg(F.count(F.lit(1)).alias(name))
    total = F.sum(name).over(Window.partitionBy(*group))
    return counts.withColumn(
        percent_name, F.col(name).cast("double") / total.cast("double") * F.lit(100.0)
    )


def distinct_with_null(c: str) -> Column:
    """Distinct values, a null counting as one more."""
    return F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int")).cast("long")


def sum_or_zero(c: str) -> Column:
    return F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("long")


def yearly_summary(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("events"),
            sum_or_zero("fatalities").alias("total_fatalities"),
            distinct_with_null("location").alias("unique_locations"),
        )
        .orderBy("year")
    )


def country_year_summary(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("country", "year")
        .agg(F.count(F.lit(1)).alias("events"), sum_or_zero("fatalities").alias("total_fatalities"))
        .orderBy("country", "year")
    )


def global_stats(events: DataFrame, date: str = "event_date") -> DataFrame:
    """One row about the whole table.

    Rows are first merged per combination of the counted columns: several
    distinct counts over the rows themselves would copy each row for each.
    """
    counted = ("country", "assoc_actor_1", "assoc_actor_2")
    merged = events.groupBy(*counted).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )
    return merged.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        distinct_with_null("country").alias("countries"),
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        distinct_with_null("assoc_actor_1").alias("primary_actors"),
        distinct_with_null("assoc_actor_2").alias("secondary_actors"),
    )


def missing_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Null or empty values per column, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(is_missing(c)).alias(f"{c}_missing") for c in columns],
    )


def rate_by(df: DataFrame, flag: str, *by: str) -> DataFrame:
    """Group size, rows with the flag, and their percentage, highest first."""
    grouped = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("with_police")
    )
    return grouped.withColumn("pct", percent(F.col("with_police"), F.col("total"))).orderBy(
        F.desc("pct"), *by
    )


def rate_by_year(df: DataFrame, flag: str) -> DataFrame:
    """Years with at least one flagged event, against all events of the year."""
    grouped = df.groupBy("year").agg(
        F.count_if(F.col(flag)).alias("events_with_police"),
        F.count(F.lit(1)).alias("total_events_that_year"),
    )
    return (
        grouped.where(F.col("events_with_police") > 0)
        .withColumn("pct", percent(F.col("events_with_police"), F.col("total_events_that_year")))
        .orderBy("year")
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence, names: Sequence[str]) -> DataFrame:
    """Counts per row value with one column per listed value, zeros filled.

    The list is fixed, so a value without rows still gets its column and no
    extra job is needed to find the values.
    """
    pivoted = df.groupBy(rows).pivot(columns, list(values)).count()
    made = pivoted.columns[1:]
    filled = pivoted.na.fill(0, made)
    return filled.select(rows, *[F.col(f"`{m}`").alias(n) for m, n in zip(made, names)])


def top_counts(df: DataFrame, by: Sequence[str], k: int, name: str = "n") -> DataFrame:
    """The k most frequent values; equal counts fall in key order."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), *by).limit(k)


def stacked(df: DataFrame, columns: Sequence[str], field: str, value: str) -> DataFrame:
    """Columns to rows, without null values."""
    long = df.select(*columns).unpivot([], list(columns), field, value)
    return long.where(F.col(value).isNotNull())


def first_rows(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The first k rows in a stated order."""
    return df.orderBy(*order).limit(k)


def label_by_year(df: DataFrame, label: str, date: str = "event_date") -> DataFrame:
    """Events per calendar year and label."""
    dated = df.withColumn("year", F.year(F.to_date(F.col(date))))
    return dated.groupBy("year", label).agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, group: Sequence[str], score: str, k: int) -> DataFrame:
    """Rows ranked up to k in their group by score; ties are kept.

    The rank filter lets Spark cut each group before the shuffle, so a group
    with a third of all rows sends only its leading rows.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(score))
    return df.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)


def label_totals(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Sum and mean of each 0/1 label, one row per label."""
    sums = df.agg(
        *[F.sum(c).cast("long").alias(f"{c}_sum") for c in labels],
        *[F.avg(c).alias(f"{c}_mean") for c in labels],
    )
    per_label = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.coalesce(F.col(f"{c}_sum"), F.lit(0)).alias("positive"),
                F.col(f"{c}_mean").alias("mean"),
            )
            for c in labels
        ]
    )
    return sums.select(F.inline(per_label))


def score_summary(df: DataFrame, scores: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Rows strictly above the threshold per score, and their share."""
    sums = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(c) > threshold).alias(c) for c in scores],
    )
    per_label = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.col(c).alias("cases"),
                F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")).alias("share"),
            )
            for c in scores
        ]
    )
    return sums.select(F.inline(per_label))
