"""Joins against a lookup table whose size is measured first.

A table that fits is broadcast, so the large side is not shuffled at all.  A
table that does not fit is joined by shuffle, and the hot keys of the large
side, which are few by definition, are spread over many tasks by a salt taken
from the row's content.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.operators.rows import computed_once
from rallylens.storage import settle

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 48
# A hot key is spread over as many tasks as it has this many rows.
ROWS_PER_SALT = 1_000_000
NO_KEY_SALTS = 1 << 20
# A key is hot when it holds more than 1/HOT_KEYS of the rows; there can be no
# more than HOT_KEYS such keys, which bounds their broadcast.
HOT_KEYS = 10_000
# Longer texts are not looked up, which bounds the table of frequent ones.
LONGEST_VALUE = 1024
_SALT, _HOT, _N, _COPY, _KNOWN, _TEXT = "__salt", "__hot", "__n", "__copy", "__known", "__text"


def table_bytes(table: DataFrame) -> int:
    """Estimated in-memory size, from one small aggregation."""
    fixed = ROW_OVERHEAD + 8 * len(table.columns)
    texts = [f.name for f in table.schema if isinstance(f.dataType, T.StringType)]
    sums = [F.sum(F.octet_length(F.col(c))).alias(c) for c in texts]
    row = table.agg(F.count(F.lit(1)).alias("__rows"), *sums).first()
    return row["__rows"] * fixed + sum(row[c] or 0 for c in texts)


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """``table`` should be settled (or a plain file scan): it is read twice."""
    return table_bytes(table) <= limit


def hot_keys(left: DataFrame, on: Sequence[str], parts: int = HOT_KEYS) -> DataFrame:
    """Keys with more than 1/parts of the rows, and their rows; fewer than ``parts`` keys."""
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias(_N))
    total = counts.agg(F.sum(_N)).scalar()
    return counts.where(F.col(_N) * F.lit(parts) > total).select(*on, F.col(_N).alias(_HOT))


def salted_join(
    left: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
    counted: DataFrame | None = None,
    merge: bool = False,
) -> DataFrame:
    """Shuffle join on (key, salt); only hot keys have more than one salt.

    A hot key gets one salt for every ``rows_per_salt`` of its rows.  Salts
    come from the row's content, so a retried task deals its rows alike; equal
    rows would share one, so ``merge`` counts them first and repeats them after
    the join.  Merging suits narrow tables with many equal rows, such as
    tokens.  Rows without a key match nothing, so any salt spreads them.  Keys
    are counted once, in ``counted`` if given: a cheaper table with the same
    rows.
    """
    hot = F.broadcast(settle(hot_keys(left if counted is None else counted, on)))
    if merge:
        columns = left.columns
        left = left.groupBy(*columns).agg(F.count(F.lit(1)).alias(_COPY))
    hashed = [f.name for f in left.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    content = F.xxhash64(*hashed)
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    salts = F.ceil(F.col(_HOT) / F.lit(rows_per_salt)).cast("int")
    salt = (
        F.when(no_key, F.pmod(content, F.lit(NO_KEY_SALTS)))
        .when(F.col(_HOT).isNotNull(), F.pmod(content, salts))
        .otherwise(0)
        .cast("int")
    )
    spread = left.join(hot, list(on), "left").withColumn(_SALT, salt).drop(_HOT)
    every = F.sequence(F.lit(0), salts - 1)
    repeated = (
        table.join(hot, list(on), "left")
        .withColumn(_SALT, F.explode(F.when(F.col(_HOT).isNotNull(), every).otherwise(F.array(F.lit(0)))))
        .drop(_HOT)
    )
    joined = spread.join(repeated, [*on, _SALT], how).drop(_SALT)
    if merge:
        joined = joined.withColumn(_COPY, F.explode(F.array_repeat(F.lit(1), F.col(_COPY).cast("int")))).drop(_COPY)
    return joined


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
    small: bool | None = None,
    counted: DataFrame | None = None,
    merge: bool = False,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join a large table to a lookup table on equal key columns.

    ``how`` is one of inner, left, left_semi, left_anti.  ``small`` skips the
    measurement for a caller that already made it; ``counted``, ``merge`` and
    ``rows_per_salt`` are explained at ``salted_join``.
    """
    on = [on] if isinstance(on, str) else list(on)
    if small is None:
        small = fits_broadcast(table, limit)
    if small:
        return left.join(F.broadcast(table), on, how)
    return salted_join(left, table, on, how, rows_per_salt, counted, merge)


def known_values(
    df: DataFrame, key: str, columns: Mapping[str, Column], name: str, counted: DataFrame | None = None
) -> DataFrame:
    """Add ``name``: a struct of ``columns``, made from the text ``key`` alone, for frequent texts; null for others.

    Frequent are texts of at most LONGEST_VALUE bytes that more than 1/HOT_KEYS
    of the rows with a repeated text hold; there are fewer than HOT_KEYS, so
    their table is broadcast.  Texts are counted once, in ``counted`` if given:
    a cheaper table with the same texts.
    """
    texts = (df if counted is None else counted).select(F.col(key).alias(_TEXT))
    counts = texts.where(F.octet_length(_TEXT) <= LONGEST_VALUE).groupBy(_TEXT).agg(F.count(F.lit(1)).alias(_N))
    repeated = settle(counts.where(F.col(_N) > 1))
    frequent = repeated.where(F.col(_N) * F.lit(HOT_KEYS) > repeated.agg(F.sum(_N)).scalar())
    made = F.struct(*[c.alias(n) for n, c in columns.items()]).alias(name)
    table = settle(frequent.select(F.col(_TEXT).alias(key)).select(F.col(key).alias(_TEXT), made))
    return df.join(F.broadcast(table), F.col(key) == F.col(_TEXT), "left").drop(_TEXT)


def computed_per_value(
    df: DataFrame, key: str, columns: Mapping[str, Column], counted: DataFrame | None = None
) -> DataFrame:
    """Add columns made from the text ``key`` alone: frequent texts look them up, any other row computes its own."""
    known = known_values(df.drop(*columns), key, columns, _KNOWN, counted)
    either = {n: F.when(F.col(_KNOWN).isNotNull(), F.col(_KNOWN)[n]).otherwise(c) for n, c in columns.items()}
    return computed_once(known, either).drop(_KNOWN)
