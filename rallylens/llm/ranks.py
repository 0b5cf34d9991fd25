"""Exact ranks inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallylens.storage import landed


def unit(h: Column) -> Column:
    """A 64-bit hash as a number from 0 up to 1, in the order of its upper bits."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def cells(rows: int) -> int:
    """How many cells ranks are counted in: as many as a cell then has rows."""
    return max(1, math.isqrt(rows))


def ranked(rows: DataFrame, group: list[str], place: Column, order: list[str], n_cells: int) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``group_rows``, one row for each of ``copies``.

    ``place`` lies from 0 up to 1, grows with ``order`` and is spread evenly.
    Rows are counted by cell of ``place``; a rank is the number of rows in the
    group's earlier cells plus the rank inside the cell.  No group column may
    be null.  ``copies`` says how many equal rows a row stands for, so a row
    that is repeated often is not gathered either.
    """
    cell = F.least(F.floor(place * n_cells), F.lit(n_cells - 1)).cast("long")
    placed = rows.withColumn("_cell", cell)
    counted = placed.groupBy(*group, "_cell").agg(F.sum("copies").alias("_n"))
    whole = W.partitionBy(*group)
    earlier = whole.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    heads = counted.withColumns(
        {"_head": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "group_rows": F.sum("_n").over(whole)}
    ).drop("_n")
    inside = W.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("_in", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    met = numbered.join(heads, [*group, "_cell"])
    each = met.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.withColumn("rank", F.col("_head") + F.col("_in") + F.col("_copy")).drop("_cell", "_head", "_in", "_copy", "copies")


def numbered(rows: DataFrame, group: str, order: list[str], kept: list[Column | str], name: str = "k") -> DataFrame:
    """``kept`` and ``name``: the place (from 1, a long) of every row in its group, nulls first; landed.

    Rows are dealt by ranges of group and order, equal rows too, so no group
    has to fit into one task.  A place is the number of the group's rows in the
    earlier ranges plus the place inside the range.
    """
    keys = [F.col(c).asc_nulls_first() for c in [group, *order, "_nth"]]
    dealt = rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = landed(dealt.select(group, *kept, F.monotonically_increasing_id().alias("_at")), "numbered")
    part = F.shiftright("_at", 33)
    heads = placed.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(group, "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    met = placed.withColumn("_part", part).join(heads, [group, "_part"])
    return met.withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_at", "_part", "_shift")


def running(rows: DataFrame, group: str, place: str, values: list[str], cell_bits: int = 10) -> DataFrame:
    """``rows`` with ``sum_<value>``: the sum of each value up to and with the row.

    ``place`` is a dense number, so a group is added up in cells of places and
    only the cells' totals meet in one window.
    """
    celled = rows.withColumn("_cell", F.shiftright(place, cell_bits))
    totals = celled.groupBy(group, "_cell").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = W.partitionBy(group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    heads = totals.select(group, "_cell", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_h_{v}") for v in values])
    inside = W.partitionBy(group, "_cell").orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    summed = celled.withColumns({f"_i_{v}": F.sum(v).over(inside) for v in values}).join(heads, [group, "_cell"])
    return summed.select(*rows.columns, *[(F.col(f"_h_{v}") + F.col(f"_i_{v}")).alias(f"sum_{v}") for v in values])
