"""Samples and splits in hash order.

Rows are ordered by ``md5(seed|key)``.  The order depends on nothing but the
seed and the key, so a sample is the same for every partition layout and every
retry.  The key must identify a row.

Exact sizes never need a global sort.  Rows are counted per hash prefix (at
most 16**PREFIX groups) to find the prefix in which the sample ends, then again
inside that prefix, until few rows are left.  That gives the last row of the
sample, and the sample itself is a plain filter on the hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallylens.storage import settle

PREFIX = 4
HASH_LENGTH = 32
# Hashes that may be put in order at once when the last prefix is reached.
LAST_ROUND = 10_000
_HASH, _BUCKET, _BEFORE = "__hash", "__bucket", "__before"


def hash_order(key: str | Sequence[str], seed: int) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed: int = 123) -> DataFrame:
    """n rows of each group; each task keeps at most n rows per group."""
    w = Window.partitionBy(group).orderBy(hash_order(key, seed), F.col(key))
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def last_hash(df: DataFrame, size_of: Callable[[int], int], key: str, seed: int) -> str | None:
    """Hash of the last row among the first ``size_of(rows)`` in hash order.

    None when the size is 0.  Each round groups by the next PREFIX digits; the
    driver sees one count per group and finally one row.  Only the hashes are
    settled, so what made the rows does not run again for each round.
    """
    left = settle(df.select(hash_order(key, seed).alias(_HASH)))
    wanted, known = None, 0
    while True:
        digits = F.substring(F.col(_HASH), known + 1, PREFIX).alias("digits")
        counts = sorted(left.groupBy(digits).agg(F.count(F.lit(1)).alias("n")).collect())
        if wanted is None:
            wanted = size_of(sum(c.n for c in counts))
            if wanted <= 0:
                return None
        for c in counts:
            if wanted <= c.n:
                break
            wanted -= c.n
        left = left.where(digits == c.digits)
        known += PREFIX
        if c.n <= LAST_ROUND or known >= HASH_LENGTH:
            break
    if known >= HASH_LENGTH:
        return left.agg(F.max(_HASH)).first()[0]
    return left.orderBy(_HASH).limit(wanted).agg(F.max(_HASH)).first()[0]


def _inside(df: DataFrame, size_of: Callable[[int], int], key: str, seed: int) -> Column:
    last = last_hash(df, size_of, key, seed)
    return F.lit(False) if last is None else hash_order(key, seed) <= last


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 123) -> DataFrame:
    """The rows up to the n-th in hash order, or all when there are fewer.

    A filter on the hash for every n, so a sample never passes through one
    task.  Should the n-th key repeat, rows with that key stay together and
    the sample is larger than n by those.
    """
    return df.where(_inside(df, lambda rows: min(n, rows), key, seed))


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 123) -> DataFrame:
    """Exactly round(fraction * rows) rows, halves to even.

    Should a key repeat, rows with the same key stay together.
    """
    return df.where(_inside(df, lambda rows: round(fraction * rows), key, seed))


def train_test_flag(
    df: DataFrame, test_fraction: float, key: str, seed: int = 42, flag: str = "is_test"
) -> DataFrame:
    """Flag ceil(test_fraction * rows) rows as test; equal keys stay together."""
    return df.withColumn(flag, _inside(df, lambda rows: math.ceil(test_fraction * rows), key, seed))


def dense_id(
    df: DataFrame, key: str, name: str = "row_id", seed: int = 0, prefix: int = PREFIX
) -> DataFrame:
    """Ids 1..n without gaps, in hash order; one shuffle by hash prefix.

    The key must identify a row: prefixes are even only if keys do not repeat.
    The rows before each prefix are known from a table of at most 16**prefix
    counts (65,536), which bounds its broadcast and the window that adds it up.
    Where ids only have to be unique, ``F.monotonically_increasing_id()``
    needs no shuffle.
    """
    hashed = df.withColumn(_HASH, hash_order(key, seed)).withColumn(
        _BUCKET, F.substring(F.col(_HASH), 1, prefix)
    )
    counts = hashed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select(_BUCKET, (F.sum("c").over(earlier) - F.col("c")).alias(_BEFORE))
    inside = Window.partitionBy(_BUCKET).orderBy(_HASH, key)
    return (
        hashed.join(F.broadcast(before), _BUCKET)
        .withColumn(name, F.row_number().over(inside).cast("long") + F.col(_BEFORE))
        .drop(_HASH, _BUCKET, _BEFORE)
    )
