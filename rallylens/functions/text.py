"""Text columns: cleaning, splitting, matching and counting.

Every function takes and returns ``Column``; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is taken off an actor field before it is split.
REMARK_PATTERN = r"\[[^\]]+\]"
PREFIX_PATTERN = "^members of |^supporters of |^protesters from "

# Filler around a standardised actor name.
FILLER_PATTERN = r"^the\s+|\s+the\s+|\s+group$|\s+movement$"

# Own list of contractions, most specific first.
WORD_END = r"($|[^\p{L}\p{Nd}])"
CONTRACTIONS = (
    ("won['’]t", "will not"),
    ("can['’]t", "cannot"),
    ("shan['’]t", "shall not"),
    ("let['’]s", "let us"),
    (r"(^|[^\p{L}\p{Nd}])(it|he|she|that|there|here|what|who|where|how)['’]s", "$1$2 is"),
    ("n['’]t", " not"),
    ("['’]re", " are"),
    ("['’]ve", " have"),
    ("['’]ll", " will"),
    ("['’]m", " am"),
    ("['’]d", " would"),
)

# What any of them ends with; a text without it is left alone.
CONTRACTED = "['’](?i:t|s|re|ve|ll|m|d)" + WORD_END

# Java otherwise lets "." stop at carriage returns and U+0085/2028/2029 too.
NEWLINE_ONLY = "(?d)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times in ``body``.

    Plain nesting would repeat the value at each use, and a chain of steps
    would then grow exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_of(patterns: Iterable[str]) -> str:
    """Join alternatives so that a row is scanned once for all of them."""
    return NEWLINE_ONLY + "|".join(f"(?:{p})" for p in patterns)


def found(c: Column | str, *patterns: str) -> Column:
    """True when any pattern is found anywhere; null text gives null."""
    return _col(c).rlike(one_of(patterns))


def found_any_case(c: Column | str, *patterns: str) -> Column:
    return _col(c).rlike("(?i)" + one_of(patterns))


def word_pattern(key: str) -> str:
    """Whole-word match; ``(?U)`` makes accented letters word characters."""
    return rf"(?U)\b(?:{key})\b"


def has_word(c: Column | str, *keys: str) -> Column:
    return _col(c).rlike(word_pattern("|".join(keys)))


def count_word(c: Column | str, *keys: str) -> Column:
    return F.regexp_count(_col(c), F.lit(word_pattern("|".join(keys))))


def squish(c: Column | str) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def strip_remarks(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), REMARK_PATTERN, "")


def strip_prefix(c: Column | str) -> Column:
    """Only at the start of the whole field, only in lower case."""
    return F.regexp_replace(_col(c), PREFIX_PATTERN, "")


def parse_actor(c: Column | str) -> Column:
    return squish(strip_prefix(strip_remarks(c)))


def split_names(parsed: Column | str) -> Column:
    """Names of a parsed field, trimmed; empty parts are kept."""
    return F.split(_col(parsed), " *; *", -1)


def or_empty(c: Column | str) -> Column:
    """Null becomes empty text, anything else its text form."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def is_missing(c: Column | str) -> Column:
    return _col(c).isNull() | (_col(c) == "")


def is_blank(c: Column | str) -> Column:
    return F.trim(or_empty(c)) == ""


def shorter_than(c: Column | str, length: int) -> Column:
    """Null, or fewer characters than ``length`` once trimmed."""
    c = _col(c)
    return c.isNull() | (F.length(F.btrim(c, F.lit(" \t\r\n"))) < length)


def leading(c: Column | str, length: int) -> Column:
    return F.substring(_col(c), 1, length)


def expand_contractions(c: Column | str) -> Column:
    c = out = _col(c)
    for short, full in CONTRACTIONS:
        out = F.regexp_replace(out, f"(?i){short}{WORD_END}", f"{full}${short.count('(') + 1}")
    # A plain search is cheap and spares most texts the pattern.
    marked = c.contains("'") | c.contains("’")
    return F.when(marked & c.rlike(CONTRACTED), out).otherwise(c)


def words_only(c: Column | str) -> Column:
    """Anything but letters, digits and blanks becomes a blank."""
    return F.regexp_replace(_col(c), r"[^\p{L}\p{Nd} ]", " ")


def punctuation_to_blank(c: Column | str) -> Column:
    """Unicode punctuation only; symbols such as ``$`` and ``+`` stay."""
    return F.regexp_replace(_col(c), r"\p{P}", " ")


def clean_note(c: Column | str) -> Column:
    """Lower-case words of a note with single blanks between them."""
    words = F.regexp_replace(expand_contractions(or_empty(c)), r"[^\p{L}\p{Nd}]+", " ")
    return F.trim(F.lower(words))


def standardise_actor(c: Column | str) -> Column:
    lowered = F.lower(or_empty(c))
    return squish(punctuation_to_blank(F.regexp_replace(lowered, FILLER_PATTERN, " ")))


def slug(c: Column | str) -> Column:
    """Name as used in file names: lower case, blanks as underscores."""
    return F.lower(F.replace(_col(c), F.lit(" "), F.lit("_")))


def logistic(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two digits, exact halves to the even digit."""
    ratio = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.bround(ratio, 2)


def day_month_year(c: Column | str) -> Column:
    return F.to_date(_col(c), "dd/MM/yyyy")
