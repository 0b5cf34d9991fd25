"""Label rules compiled to columns.

A flag is only ever switched on, so all rules of one label fold into a single
OR: one membership test for the exact names and one regex for the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallylens.functions.text import found
from rallylens.rules.packs import LABELS, STAGES, LabelRule


def any_rule(name: Column, rules: Iterable[LabelRule]) -> Column:
    """True when one of the rules holds for the clean name, never null."""
    rules = list(rules)
    exact = [r.pattern for r in rules if r.kind == "eq"]
    searched = [r.pattern for r in rules if r.kind == "regex"]
    lowered = F.lower(name)
    tests = []
    if exact:
        tests.append(name.isin(exact))
    if searched:
        tests.append(found(lowered, *searched))
    for r in rules:
        if r.kind == "regex_not":
            tests.append(found(lowered, r.pattern) & ~found(lowered, r.unless))
    if not tests:
        return F.lit(False)
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return F.coalesce(hit & (name != ""), F.lit(False))


def label_flags(name: Column | str, rules: Sequence[LabelRule]) -> dict[str, Column]:
    """0/1 columns left, right and centre for a clean name."""
    name = F.col(name) if isinstance(name, str) else name
    return {
        label: any_rule(name, [r for r in rules if r.label == label]).cast("int") for label in LABELS
    }


def label_flags_by(
    name: Column | str, scope: Column | str, packs: Mapping[str, Sequence[LabelRule]]
) -> dict[str, Column]:
    """As ``label_flags``, with the pack chosen by the value of ``scope``.

    A row is tested against its own pack only; without a pack no flag is set.
    """
    scope = F.col(scope) if isinstance(scope, str) else scope
    each = {value: label_flags(name, rules) for value, rules in packs.items()}
    out = {}
    for label in LABELS:
        chain = None
        for value, flags in each.items():
            test = scope == value
            chain = F.when(test, flags[label]) if chain is None else chain.when(test, flags[label])
        out[label] = F.lit(0) if chain is None else chain.otherwise(0)
    return out


def no_flag(flags: Iterable[Column]) -> Column:
    """1 when none of the flags is set."""
    return F.lit(1) - F.greatest(*flags)


def first_stage(name: Column | str, rules: Sequence[LabelRule], stages: Sequence[str] = STAGES) -> Column:
    """Number (from 1) of the first stage with a hit; null when there is none."""
    name = F.col(name) if isinstance(name, str) else name
    chain = None
    for number, stage in enumerate(stages, start=1):
        held = [r for r in rules if r.stage == stage]
        if not held:
            continue
        hit = any_rule(name, held)
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return F.lit(None).cast("int") if chain is None else chain
