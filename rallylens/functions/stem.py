"""The Porter stemmer (Porter 1980) as column expressions.

Rules are tables of (suffix, replacement); each step looks for the longest
suffix of its table and applies it when its condition on the rest holds.  A
``y`` that acts as a consonant is written ``Y`` during the steps, so the
measure of a stem is a plain regex over vowels and consonants.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallylens.functions.text import let

Rule = tuple[str, str | None, str]

VOWEL = "[aeiouy]"
CONSONANT = "[^aeiouy]"
HAS_VOWEL = VOWEL
# One vowel-consonant change in the stem, and two of them.
MEASURE_1 = f"{VOWEL}{CONSONANT}"
MEASURE_2 = f"{VOWEL}{CONSONANT}+{VOWEL}+{CONSONANT}"
# Consonant, vowel, consonant other than w, x, Y at the end.
SHORT_END = f"{CONSONANT}{VOWEL}[^aeiouywxY]$"
# The measure is exactly one and the only change is at the end.
ONE_CHANGE = f"^{CONSONANT}*{VOWEL}+{CONSONANT}$"
DOUBLE_END = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"

# The suffix tables of the published algorithm.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_1B = (("eed", MEASURE_1, "ee"), ("ed", HAS_VOWEL, ""), ("ing", HAS_VOWEL, ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("entli", "ent"), ("eli", "e"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alli", "al"), ("alism", "al"), ("aliti", "al"), ("fulness", "ful"),
    ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ative", ""), ("ful", ""),
    ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)


def _rest(w: Column, suffix: str | Column) -> Column:
    size = F.lit(len(suffix)) if isinstance(suffix, str) else F.length(suffix)
    return F.substring(w, F.lit(1), F.length(w) - size)


def _longest_suffix(w: Column, suffixes: Sequence[str]) -> Column:
    """The longest of the suffixes at the end of the word, or empty.

    A search takes the leftmost match, and at the end of a word that is the
    longest suffix, so one regex serves the whole table.
    """
    return F.regexp_extract(w, f"({'|'.join(suffixes)})$", 1)


def _swap(w: Column, rules: Sequence[Rule], then: Callable[[Column, Column], Column] | None = None) -> Column:
    """Replace the longest suffix when its condition on the rest holds.

    ``then`` continues with the shortened word and the suffix taken off.
    """

    def replace(suffix: Column) -> Column:
        rest = _rest(w, suffix)
        allowed = suffix != ""
        for condition in sorted({r[1] for r in rules if r[1]}):
            bound = [r[0] for r in rules if r[1] == condition]
            allowed = allowed & (~suffix.isin(bound) | rest.rlike(condition))
        endings = None
        for new in sorted({r[2] for r in rules if r[2]}):
            hit = suffix.isin([r[0] for r in rules if r[2] == new])
            endings = F.when(hit, new) if endings is None else endings.when(hit, new)
        changed = rest if endings is None else F.concat(rest, endings.otherwise(""))
        if then is not None:
            changed = let(changed, lambda shortened: then(shortened, suffix))
        return F.when(allowed, changed).otherwise(w)

    return let(_longest_suffix(w, [r[0] for r in rules]), replace)


def _repair(w: Column, suffix: Column) -> Column:
    """Put right what taking off -ed or -ing left behind."""
    return (
        F.when(~suffix.isin("ed", "ing"), w)
        .when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
        .when(w.rlike(DOUBLE_END), _rest(w, "x"))
        .when(w.rlike(ONE_CHANGE) & w.rlike(SHORT_END), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _final_y(w: Column) -> Column:
    return F.when(w.rlike(f"{VOWEL}.*[yY]$"), F.concat(_rest(w, "y"), F.lit("i"))).otherwise(w)


def _final_e(w: Column) -> Column:
    rest = _rest(w, "e")
    drop = rest.rlike(MEASURE_2) | (rest.rlike(MEASURE_1) & ~rest.rlike(SHORT_END))
    return F.when(w.endswith("e") & drop, rest).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & _rest(w, "l").rlike(MEASURE_2), _rest(w, "l")).otherwise(w)


def stem(word: Column | str) -> Column:
    """Stem of a lower-case word."""
    word = F.col(word) if isinstance(word, str) else word
    ion: Rule = ("ion", f"{MEASURE_2}.*[st]$|{VOWEL}{CONSONANT}+{VOWEL}+[st]$", "")
    steps: list[Callable[[Column], Column]] = [
        lambda w: _swap(w, [(s, None, new) for s, new in STEP_1A]),
        lambda w: _swap(w, STEP_1B, _repair),
        _final_y,
        lambda w: _swap(w, [(s, MEASURE_1, new) for s, new in STEP_2]),
        lambda w: _swap(w, [(s, MEASURE_1, new) for s, new in STEP_3]),
        lambda w: _swap(w, [*[(s, MEASURE_2, "") for s in STEP_4], ion]),
        _final_e,
        _final_l,
    ]
    out = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")
    for step in steps:
        out = let(out, step)
    return F.translate(out, "Y", "y")
