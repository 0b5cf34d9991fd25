"""Ordered decisions: the first step that holds decides the row.

The steps become one CASE expression, which Spark evaluates lazily and in
order, so a later step costs nothing for rows that were decided before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallylens.functions.text import found, found_any_case, shorter_than
from rallylens.operators.lookup import known_values
from rallylens.operators.rows import computed_once
from rallylens.rules.packs import MIN_NOTE_LENGTH, PRESENCE_STEPS, FieldTest, Step

TOO_SHORT = "0"
UNDECIDED = "none"
_LOWERED, _KNOWN = "__lowered", "__known"


def _test(t: FieldTest) -> Column:
    if t.op == "eq":
        return F.col(t.column) == t.value
    if t.op == "regex":
        return found_any_case(t.column, t.value)
    raise ValueError(f"unknown field test {t.op!r}")


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _text_holds(step: Step, lowered: Column) -> Column | None:
    """What the step asks of the text; None if nothing."""
    parts = [_any([lowered.contains(n) for n in step.needs])] if step.needs else []
    if step.patterns:
        parts.append(found(lowered, *step.patterns))
    return reduce(lambda a, b: a & b, parts) if parts else None


def _holds(step: Step, text_holds: Column | None) -> Column:
    parts = [_test(t) for t in step.tests]
    if text_holds is not None:
        parts.append(text_holds)
    return reduce(lambda a, b: a & b, parts)


def _chain(text: str, steps: Sequence[Step], text_holds: Sequence[Column | None], min_length: int) -> Column:
    chain = F.when(shorter_than(text, min_length), TOO_SHORT)
    for step, holds in zip(steps, text_holds):
        chain = chain.when(_holds(step, holds), step.name)
    return chain.otherwise(UNDECIDED)


def deciding_step(
    text: str, lowered: Column, steps: Sequence[Step], min_length: int = MIN_NOTE_LENGTH
) -> Column:
    """Name of the step that decides; null fields make a step not hold."""
    return _chain(text, steps, [_text_holds(s, lowered) for s in steps], min_length)


def decide(
    df: DataFrame,
    text: str,
    steps: Sequence[Step],
    result: str,
    step: str = "step",
    min_length: int = MIN_NOTE_LENGTH,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the deciding step and its boolean result; no shuffle.

    The lower-cased text and the step are made once per row, also when the
    result is filtered.  With ``counted``, a table with the same texts, those
    that many rows share are searched once for all steps beforehand
    (``known_values``; not for streams).
    """
    positive = [s.name for s in steps if s.result]
    lower, decided = F.lower(F.col(text)), deciding_step(text, F.col(_LOWERED), steps, min_length)
    if counted is not None:
        asked = {f"s{i}": holds for i, s in enumerate(steps) if (holds := _text_holds(s, lower)) is not None}
        df = known_values(df, text, asked, _KNOWN, counted)
        known = [F.col(_KNOWN)[f"s{i}"] if f"s{i}" in asked else None for i in range(len(steps))]
        unknown = F.col(_KNOWN).isNull()
        lower = F.when(unknown, lower)
        decided = F.when(unknown, decided).otherwise(_chain(text, steps, known, min_length))
    lowered = computed_once(df, {_LOWERED: lower})
    stepped = computed_once(lowered, {step: decided})
    return stepped.drop(_LOWERED, _KNOWN).withColumn(result, F.col(step).isin(positive))


def police_presence(
    events: DataFrame, steps: Sequence[Step] = PRESENCE_STEPS, counted: DataFrame | None = None
) -> DataFrame:
    """Events with ``police_presence`` and ``presence_step``."""
    return decide(events, "notes", steps, "police_presence", "presence_step", counted=counted)
