"""Actor dictionary, labels of names, and their way back to the events.

An event has four fields, each a ``;``-separated list of names.  The costly
rules run on distinct values only: distinct field strings, then distinct
names.  The labels return to the events by a lookup on the field string.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallylens.functions.text import parse_actor, split_names
from rallylens.operators.lookup import BROADCAST_BYTES, fits_broadcast, lookup_join
from rallylens.rules.labels import any_rule, first_stage, label_flags, label_flags_by, no_flag
from rallylens.rules.packs import LABELS, STAGES, LabelRule
from rallylens.storage import settle

# Source field -> prefix of its flag columns.
ACTOR_FIELDS = {
    "actor1": "actor1",
    "actor2": "actor2",
    "assoc_actor_1": "assoc_actor1",
    "assoc_actor_2": "assoc_actor2",
}
FLAGS = (*LABELS, "unknown")


def field_values(
    events: DataFrame, fields: Sequence[str] = tuple(ACTOR_FIELDS), keep: Sequence[str] = ()
) -> DataFrame:
    """The actor fields stacked into one column, without nulls."""
    stacked = events.select(*keep, F.explode(F.array(*[F.col(f) for f in fields])).alias("actor_raw"))
    return stacked.where(F.col("actor_raw").isNotNull())


def field_names(raws: DataFrame) -> DataFrame:
    """One row per name of each field string."""
    name = F.explode(split_names(parse_actor("actor_raw"))).alias("actor_clean")
    return raws.select(*raws.columns, name).where(F.col("actor_clean") != "")


def actor_dictionary(events: DataFrame, fields: Sequence[str] = tuple(ACTOR_FIELDS)) -> DataFrame:
    """Distinct clean names.  Parsing happens on distinct field strings."""
    names = field_names(field_values(events, fields).distinct())
    return (
        names.select("actor_clean")
        .distinct()
        .withColumn("actor_clean_lower", F.lower(F.col("actor_clean")))
    )


def label_dictionary(dictionary: DataFrame, rules: Sequence[LabelRule]) -> DataFrame:
    """Dictionary with the flags left, right, centre, unknown."""
    flagged = dictionary.withColumns(label_flags("actor_clean", rules))
    return flagged.withColumn("unknown", no_flag(F.col(c) for c in LABELS))


def label_by_table(dictionary: DataFrame, exact: DataFrame) -> DataFrame:
    """Dictionary with flags from a table of exact names, of any size.

    ``exact``: pattern and label, as in a rule table.  A name may have several
    labels; names not listed are unknown.
    """
    flags = [F.max((F.col("label") == c).cast("int")).alias(c) for c in LABELS]
    single = settle(exact.groupBy(F.col("pattern").alias("actor_clean")).agg(*flags))
    joined = lookup_join(dictionary, single, "actor_clean", "left").na.fill(0, list(LABELS))
    return joined.withColumn("unknown", no_flag(F.col(c) for c in LABELS))


def stage_coverage(
    dictionary: DataFrame, rules: Sequence[LabelRule], stages: Sequence[str] = STAGES
) -> DataFrame:
    """Names classified and still unknown after each rule stage, in one pass."""
    hit = dictionary.select(first_stage("actor_clean", rules, stages).alias("hit"))
    sums = hit.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("hit") <= n).alias(f"s{n}") for n in range(1, len(stages) + 1)],
    )
    per_stage = F.array(
        *[
            F.struct(
                F.lit(n).alias("stage_no"),
                F.lit(stage).alias("stage"),
                F.col(f"s{n}").alias("classified"),
                (F.col("total") - F.col(f"s{n}")).alias("unknown"),
            )
            for n, stage in enumerate(stages, start=1)
        ]
    )
    return sums.select(F.inline(per_stage))


def flags_of_fields(
    raws: DataFrame,
    rules: Sequence[LabelRule] | Mapping[str, Sequence[LabelRule]] | None = None,
    dictionary: DataFrame | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Flags of each distinct field string: any name left, right, centre.

    Names get their flags from the rules, or from a labelled dictionary (for
    example one corrected by hand).  Names absent from it carry no flag; of
    several rows for one name a single one is used.  With ``scope`` the rules
    are packs by the value of that column.
    """
    names = field_names(raws)
    if dictionary is not None:
        single = (
            dictionary.groupBy("actor_clean")
            .agg(F.max(F.struct(*LABELS)).alias("f"))
            .select("actor_clean", *[F.col("f")[c].cast("int").alias(c) for c in LABELS])
        )
        names = lookup_join(names, settle(single), "actor_clean", "left")
        flags = {c: F.coalesce(F.col(c), F.lit(0)) for c in LABELS}
    elif rules is None:
        raise ValueError("give rules or a dictionary")
    elif scope is not None:
        flags = label_flags_by("actor_clean", scope, rules)
    else:
        flags = label_flags("actor_clean", rules)
    flagged = names.select(*raws.columns, *[c.alias(n) for n, c in flags.items()])
    return flagged.groupBy(*raws.columns).agg(*[F.max(c).alias(c) for c in LABELS])


def _any_name(names: Column, rules: Sequence[LabelRule]) -> Column:
    hit = F.exists(names, lambda name: any_rule(name, rules))
    return F.coalesce(hit, F.lit(False)).cast("int")


def _inline_flags(
    field: str, rules: Sequence[LabelRule] | Mapping[str, Sequence[LabelRule]], scope: str | None
) -> dict[str, Column]:
    names = split_names(parse_actor(field))
    out = {}
    for label in LABELS:
        if scope is None:
            out[label] = _any_name(names, [r for r in rules if r.label == label])
            continue
        chain = F.when(F.lit(False), 0)
        for value, pack in rules.items():
            hit = _any_name(names, [r for r in pack if r.label == label])
            chain = chain.when(F.col(scope) == value, hit)
        out[label] = chain.otherwise(0)
    return out


def inline_field_flags(
    events: DataFrame,
    rules: Sequence[LabelRule] | Mapping[str, Sequence[LabelRule]],
    fields: dict[str, str] | None = None,
    scope: str | None = None,
) -> DataFrame:
    """Field flags without any join: rules run on each row.

    Costs more processor time per row but never shuffles and needs no table
    made beforehand, which suits streams.
    """
    out = events
    for field, prefix in (fields or ACTOR_FIELDS).items():
        out = out.withColumns({f"{prefix}_{k}": v for k, v in _inline_flags(field, rules, scope).items()})
        out = out.withColumn(f"{prefix}_unknown", no_flag(F.col(f"{prefix}_{c}") for c in LABELS))
    return out


def map_partisanship(
    events: DataFrame,
    rules: Sequence[LabelRule] | Mapping[str, Sequence[LabelRule]] | None = None,
    dictionary: DataFrame | None = None,
    fields: dict[str, str] | None = None,
    scope: str | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Events with four flags per actor field; every row kept once.

    Distinct field strings are labelled once and settled, then measured.  A
    table that fits is broadcast, a larger one is joined by salted shuffle.

    ``scope`` names a column, such as the country, whose value picks one of
    several rule packs; all countries are then labelled in one run.
    """
    fields = fields or ACTOR_FIELDS
    keys = [scope] if scope else []
    raws = field_values(events, tuple(fields), keys).distinct()
    table = settle(flags_of_fields(raws, rules, dictionary, scope))
    small = fits_broadcast(table, limit)
    out = events
    for field, prefix in fields.items():
        renamed = table.select(
            *keys, F.col("actor_raw").alias(field), *[F.col(c).alias(f"{prefix}_{c}") for c in LABELS]
        )
        out = lookup_join(out, renamed, [*keys, field], "left", small=small, counted=events)
    columns = [f"{p}_{c}" for p in fields.values() for c in LABELS]
    out = out.na.fill(0, columns)
    unknown = {f"{p}_unknown": no_flag(F.col(f"{p}_{c}") for c in LABELS) for p in fields.values()}
    order = [f"{p}_{c}" for p in fields.values() for c in FLAGS]
    return out.withColumns(unknown).select(*events.columns, *order)


def event_type(left: Column, right: Column, centre: Column) -> Column:
    """First match wins; all three flags give left_vs_right."""
    l, r, c = left == 1, right == 1, centre == 1
    return (
        F.when(l & r, "left_vs_right")
        .when(l & c, "left_vs_centre")
        .when(r & c, "right_vs_centre")
        .when(l, "left_only")
        .when(r, "right_only")
        .when(c, "centre_only")
        .otherwise("unknown")
    )


def event_partisanship(flagged: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Event-level flags and type from the field flags (null flags count as 0)."""
    prefixes = list((fields or ACTOR_FIELDS).values())
    filled = flagged.na.fill(0, [f"{p}_{c}" for p in prefixes for c in FLAGS])
    events = filled.withColumns(
        {f"event_{c}": F.greatest(*[F.col(f"{p}_{c}") for p in prefixes]) for c in LABELS}
    )
    return events.withColumn(
        "event_partisan_type",
        event_type(F.col("event_left"), F.col("event_right"), F.col("event_centre")),
    )


def classify_events(
    events: DataFrame,
    rules: Sequence[LabelRule] | Mapping[str, Sequence[LabelRule]] | None = None,
    dictionary: DataFrame | None = None,
    scope: str | None = None,
) -> DataFrame:
    return event_partisanship(map_partisanship(events, rules, dictionary, scope=scope))


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def lean_of_family(df: DataFrame, family: str, leans: DataFrame) -> DataFrame:
    """Party family number to lean; numbers without a lean are unknown."""
    table = leans.select(F.col("family").alias(family), "lean")
    joined = lookup_join(df, table, family, "left")
    return joined.withColumn("lean", F.coalesce(F.col("lean"), F.lit("unknown")))


def override_labels(
    events: DataFrame, corrections: DataFrame, key: str, label: str, corrected: str = "corrected"
) -> DataFrame:
    """Replace ``label`` where a correction for ``key`` exists.

    The key names one event on both sides, so no key is hot and Spark may
    choose the join by the size of the corrections.
    """
    joined = events.join(corrections.select(key, corrected), key, "left")
    return joined.withColumn(label, F.coalesce(F.col(corrected), F.col(label))).drop(corrected)
