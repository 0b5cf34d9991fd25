"""Label rules of any number, found by the pieces of text they need.

A rule table is not turned into one expression here.  Its alternatives that are
plain text, and the plain pieces its other patterns need, are indexed by the run
of characters that the fewest names hold: of all pieces of an alternative, and of
runs as long as a piece allows (``RUNS``), so that a piece every name shares is
never what brings a rule and a name together if another piece tells names apart.
Distinct names meet only the rules whose run they hold, and the pattern itself
decides.  Rules are never collected, but for those that need no plain piece of
three characters: each of them is tested on every name, so there may be
``MOST_FREE`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallylens.operators.lookup import lookup_join
from rallylens.rules.labels import label_flags, no_flag
from rallylens.rules.packs import LABELS, LabelRule
from rallylens.storage import settle, spread

GRAM = 3
# Lengths of the runs that are looked up; a piece is found by the longest it holds.
RUNS = (GRAM, 5, 8)
MOST_FREE = 1000
SPECIAL = r"\\\[\](){}.*+?^$"


def grams(text: Column, length: int = GRAM) -> Column:
    """Distinct runs of ``length`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(length))))).otherwise(F.array().cast("array<string>"))


def hashed(runs: Column) -> Column:
    return F.transform(runs, lambda r: F.xxhash64(r))


def piece_keys(piece: Column) -> Column:
    """Hashes of the runs by which a piece is looked up: of the longest length it holds."""
    chain = F.when(F.length(piece) >= RUNS[-1], hashed(grams(piece, RUNS[-1])))
    for length in RUNS[-2::-1]:
        chain = chain.when(F.length(piece) >= length, hashed(grams(piece, length)))
    return chain.otherwise(F.array().cast("array<bigint>"))


def name_keys(name: Column) -> Column:
    """Hashes of all runs of a name that a piece may be looked up by."""
    return F.array_distinct(F.concat(*[hashed(grams(name, n)) for n in RUNS]))


def plain_pieces(pattern: Column) -> Column:
    """The plain pieces a pattern cannot match without, and their lengths; one empty piece if they are not plain to see."""
    gaps = F.regexp_replace(pattern, r"\\.|\[[^\]]*\][*+?]?|.[*?]|[.^$+]", "\n")
    gaps = F.when(pattern.rlike(r"[|({]|\\[A-Za-z0-9]"), "").otherwise(gaps)
    return F.transform(F.split(gaps, "\n"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))


def needed(pattern: Column) -> Column:
    """The longest of them; empty if there is none."""
    return F.array_max(plain_pieces(pattern))["p"]


def indexed(rules: DataFrame) -> DataFrame:
    """label, piece, pieces, pattern, unless: one row per alternative; ``pattern`` is null where the piece alone decides."""
    plain = ~F.col("pattern").rlike(f"[{SPECIAL}]")
    each = F.transform(F.split("pattern", r"\|"), lambda p: F.struct(p.alias("piece"), F.array(p).alias("pieces")))
    whole = F.struct(needed(F.col("pattern")).alias("piece"), F.transform(plain_pieces(F.col("pattern")), lambda p: p["p"]).alias("pieces"))
    searched = rules.where(F.col("kind").isin("regex", "regex_not") & F.col("pattern").isNotNull())
    found = searched.select("label", F.explode(F.when(plain, each).otherwise(F.array(whole))).alias("a"), F.when(~plain, F.col("pattern")).alias("pattern"), "unless", F.col("pattern").alias("whole"))
    return found.select("label", "a.piece", "a.pieces", "pattern", "unless", "whole")


def rule_keys(pieces: DataFrame) -> DataFrame:
    """``pieces`` and key: every run by which a name holding one may be found."""
    keys = F.array_distinct(F.flatten(F.transform("pieces", piece_keys)))
    return pieces.select("label", "piece", "pattern", "unless", F.explode(keys).alias("key"))


def keyed(keys: DataFrame, posted: DataFrame) -> DataFrame:
    """``keys`` (``rule_keys``) with the one of each alternative that the fewest names hold."""
    counts = posted.groupBy("key").agg(F.count(F.lit(1)).alias("names"))
    order = F.struct(F.coalesce("names", F.lit(0)).alias("n"), F.col("key").alias("k"))
    return keys.join(counts, "key", "left").groupBy("label", "piece", "pattern", "unless").agg(F.min(order)["k"].alias("key"))


def free_rules(pieces: DataFrame) -> list[LabelRule]:
    """The rules with an alternative too short to index."""
    rows = pieces.where(F.length("piece") < GRAM).select("label", "whole", "unless").distinct().limit(MOST_FREE + 1).collect()
    if len(rows) > MOST_FREE:
        raise ValueError(f"more than {MOST_FREE} rules need no piece of {GRAM} characters")
    return [LabelRule(r.label, "regex_not" if r.unless else "regex", r.whole, r.unless) for r in rows]


def label_names(names: DataFrame, rules: DataFrame, name: str = "actor_clean") -> DataFrame:
    """``name``, left, right, centre, unknown of every distinct name.

    ``rules``: label, kind, pattern, unless, as in the rule packs.  Null and
    empty names have no flag.
    """
    distinct = settle(names.select(F.col(name)).where(F.col(name).isNotNull()).distinct())
    pieces = settle(indexed(rules))
    low = F.lower(name)
    keys = settle(rule_keys(pieces.where(F.length("piece") >= GRAM)))
    runs = spread(distinct.where(F.col(name) != "")).select(F.xxhash64(name).alias("name_id"), F.explode(name_keys(low)).alias("key"))
    posted = settle(lookup_join(runs, settle(keys.select("key").distinct()), "key", "left_semi"))
    chosen = settle(keyed(keys, posted))
    ids = settle(lookup_join(posted, settle(chosen.select("key").distinct()), "key", "left_semi"))
    named = ids.join(distinct.select(F.xxhash64(name).alias("name_id"), name), "name_id")
    met = named.join(chosen, "key")
    holds = F.contains(low, F.col("piece")) & F.coalesce(F.rlike(low, F.concat(F.lit("(?d)"), "pattern")), F.lit(True))
    holds = holds & ~F.coalesce(F.rlike(low, F.concat(F.lit("(?d)"), "unless")), F.lit(False))
    exact = rules.where("kind = 'eq'").select("label", F.col("pattern").alias(name)).join(distinct.where(F.col(name) != ""), name)
    hits = met.where(holds).select(name, "label").unionByName(exact.select(name, "label"))
    flags = hits.groupBy(name).agg(*[F.max((F.col("label") == c).cast("int")).alias(f"_{c}") for c in LABELS])
    free = label_flags(name, free_rules(pieces))
    told = distinct.join(flags, name, "left").withColumns({c: F.greatest(F.coalesce(f"_{c}", F.lit(0)), free[c]) for c in LABELS})
    return told.withColumn("unknown", no_flag(F.col(c) for c in LABELS)).select(name, *LABELS, "unknown")
