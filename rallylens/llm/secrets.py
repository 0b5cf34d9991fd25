"""Secrets: fixed forms, and credential values that are hard to guess.

Three base kinds (assign, access, hex) are leftmost, non-overlapping matches of
a pattern that pass a length test; a match that fails is dropped and not tried
again.  The added kind, guess, takes the value behind any word that announces a
credential, in four languages, and keeps it if guessing it costs ``LEAST_BITS``
or more, it mixes kinds of characters, and no base span already covers it.

The cost is the cheapest way to cut the value into words, dates, repeats,
keyboard walks and spans tried character by character, found by dynamic
programming over positions.  Every start offers each kind of segment a bounded
number of times (a repeat or walk its longest run), so the work grows with the
length of the value.  Base spans carry the cost of their value too.

Texts without any announcing word or form are ruled out by one linear scan of
the whole text; nothing is shuffled.

Defined results: a null text is empty and has no spans; offsets are code
points, ends exclusive; spans come by start, then kind; repeated rows are each
answered; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import comb, log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "guess"]
LEAST_BITS = 40.0

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = "pass(?:word|wort|wd|phrase|code)?|kennwort|contraseña|clave|mot de passe|pwd|secret|token|credentials?|bearer|auth(?:orization)?|(?:api|access|private|client|account)[_ -]?(?:key|secret)"
ANNOUNCED = re.compile(rf"""(?i)(?<![a-z])(?:{NAMES})(?![a-z])["']?(?:\s{{0,8}}[:=]{{1,2}}>?|\s(?:is|ist|es|est)(?=\s))\s{{0,8}}["'`]?([^\s"'`<>]+)""")
HINT = rf"(?i){NAMES}|passwd|api_?key|akia[a-z0-9]{{16}}|[0-9a-f]{{24}}"

# Words that are tried first, most likely first.
COMMON = (
    "password pass admin user root test guest login welcome letmein master secret qwerty dragon monkey football baseball shadow "
    "sunshine princess summer winter spring autumn monday friday january july hello love star angel money freedom hunter ranger "
    "tiger lion eagle wolf bear horse butter coffee orange apple banana cherry purple yellow silver golden green black white blue "
    "red michael daniel thomas andrew joshua jordan robert jennifer jessica charlie maria peter anna default change changeme example "
    "sample demo temp dummy none null value string token access key code server database system oracle mysql public private "
    "client account service office home computer internet windows apple google secure security passwort kennwort hallo sommer "
    "schatz clave hola amor bonjour soleil motdepasse azerty the and for you are not with this that from have your name here"
).split()
LEET = str.maketrans("@430$57!", "aaeossti")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHORTEST_WORD, LONGEST_UNIT, YEARS = 3, 8, (1900, 2049)
DATES = [
    (re.compile(r"(?:19|20)\d\d"), 0),
    (re.compile(r"(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\1(?:(?:19|20)\d\d|\d\d)"), log2(366)),
    (re.compile(r"(?:0?[1-9]|1[0-2])([-/._]?)(?:0?[1-9]|[12]\d|3[01])\1(?:(?:19|20)\d\d|\d\d)"), log2(366)),
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"), log2(366)),
]


def keyboard() -> dict[str, tuple[int, int]]:
    """Row and place of every key, in half keys."""
    return {c: (r, 2 * k + r) for r, row in enumerate(ROWS) for k, c in enumerate(row)}


KEYS = keyboard()
WALK_BITS = log2(len(KEYS))
TURN_BITS = log2(6)  # neighbours of an inner key


def step(a: str, b: str) -> tuple[int, int] | None:
    """Direction from a key to one beside it, or along the alphabet; None if they are apart."""
    if a in KEYS and b in KEYS:
        dy, dx = KEYS[b][0] - KEYS[a][0], KEYS[b][1] - KEYS[a][1]
        if (dy, dx) != (0, 0) and abs(dy) <= 1 and abs(dx) <= 2:
            return dy, dx
    if a.isascii() and b.isascii() and a.isalpha() and b.isalpha() and abs(ord(a) - ord(b)) == 1:
        return 9, ord(b) - ord(a)
    return None


def char_bits(c: str) -> float:
    """What one character costs when all of its kind are tried."""
    if not c.isascii():
        return 7.0
    return log2(10) if c.isdigit() else log2(26) if c.isalpha() else log2(33)


def capital_bits(word: str) -> float:
    """Ways to place the capitals of a word."""
    high, n = sum(c.isupper() for c in word), len(word)
    if not high:
        return 0.0
    if high == n or (high == 1 and (word[0].isupper() or word[-1].isupper())):
        return 1.0
    return log2(sum(comb(n, k) for k in range(1, min(high, n - high) + 1)))


class Guesses:
    """Costs in bits, with words ranked as given (most likely first)."""

    def __init__(self, words: tuple[str, ...] = tuple(COMMON)):
        self.rank: dict[str, int] = {}
        for word in words:
            self.rank.setdefault(word, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)
        self.unit_bits = lru_cache(maxsize=10_000)(self.bits)

    def word_bits(self, part: str) -> float | None:
        low = part.lower()
        if len(low) != len(part):
            return None
        plain = low.translate(LEET)
        found = [(self.rank[w], sum(a != b for a, b in zip(low, w, strict=True))) for w in {low, plain, plain.replace("1", "l"), plain.replace("1", "i")} if w in self.rank]
        return min((log2(rank + 1) + swaps for rank, swaps in found), default=0.0) + capital_bits(part) if found else None

    def segments(self, text: str) -> list[list[tuple[int, float]]]:
        """For every start the ends and costs of its words, dates, repeats and walks."""
        n = len(text)
        low = text.lower() if len(text.lower()) == n else text
        ways: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for start in range(n):
            for stop in range(start + SHORTEST_WORD, min(n, start + self.longest) + 1):
                bits = self.word_bits(text[start:stop])
                if bits is not None:
                    ways[start].append((stop, bits))
            if text[start].isdigit():
                for pattern, day in DATES:
                    m = pattern.match(text, start)
                    if m:
                        between = log2(4) if pattern.groups and m.group(1) else 0.0
                        ways[start].append((m.end(), log2(YEARS[1] - YEARS[0] + 1) + day + between))
        for unit in range(1, LONGEST_UNIT + 1):
            run = 0
            for start in range(n - unit - 1, -1, -1):
                run = run + 1 if text[start] == text[start + unit] else 0
                times = run // unit + 1
                if times >= 2 and times * unit >= 3:
                    ways[start].append((start + times * unit, self.unit_bits(text[start : start + unit]) + log2(times)))
        stop, turns, ahead = n, 0, None
        for start in range(n - 2, -1, -1):
            way = step(low[start], low[start + 1])
            if way is None:
                stop, turns = start + 1, 0
            else:
                if ahead is None:
                    stop, turns = start + 2, 0
                elif way != ahead:
                    turns += 1
                if stop - start >= 3:
                    bits = WALK_BITS + log2(stop - start) + (turns + 1) * TURN_BITS
                    ways[start].append((stop, bits + capital_bits(text[start:stop])))
            ahead = way
        return ways

    def bits(self, text: str) -> float:
        """The least cost of all segmentations; each segment costs a bit for its kind."""
        n, ways = len(text), self.segments(text)
        best = [0.0, *[float("inf")] * n]
        tried = float("inf")  # the best that ends in a span tried character by character
        for at in range(n):
            here = best[at]
            for stop, bits in ways[at]:
                best[stop] = min(best[stop], here + 1 + bits)
            tried = min(here + 1, tried) + char_bits(text[at])
            best[at + 1] = min(best[at + 1], tried)
        return best[n]


def mixed(value: str) -> bool:
    """Whether a value is more than a plain word or number."""
    kinds = {"a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" for c in value[:1].lower() + value[1:]}
    return len(kinds) > 1 and not re.match(r"\w+://", value) and not re.fullmatch(r"[^\W\d_]+(?:[-_/.][^\W\d_]+)*", value)


def text_spans(text: str, guesses: Guesses, least_bits: float = LEAST_BITS) -> list[tuple[str, int, int, float]]:
    """kind, start, stop and bits of every secret of a whole text, by start, then kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 6:
            found.append(("assign", *m.span(), guesses.unit_bits(m.group(2))))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(kind, *m.span(), guesses.unit_bits(m.group())) for m in pattern.finditer(text)]
    taken = sorted(f[1:3] for f in found)
    at, reached = 0, 0
    for m in ANNOUNCED.finditer(text):
        value = m.group(1).rstrip(".,;:!?)]}|")
        start, stop = m.start(1), m.start(1) + len(value)
        while at < len(taken) and taken[at][0] < stop:
            reached = max(reached, taken[at][1])
            at += 1
        if reached > start or not mixed(value):
            continue
        bits = guesses.unit_bits(value)
        if bits >= least_bits:
            found.append(("guess", start, stop, bits))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("bits", T.DoubleType())])


def spans(text: Column | str, words: tuple[str, ...] = tuple(COMMON), least_bits: float = LEAST_BITS) -> Column:
    """The secrets of a text column: kind, start, stop, bits."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("bits", pa.float64())]))

    @F.arrow_udf(T.ArrayType(SPAN))
    def told(column: pa.Array) -> pa.Array:
        guesses = Guesses(words)
        hint = pc.fill_null(pc.match_substring_regex(column, HINT), False).to_pylist()
        rows = [text_spans(t.as_py(), guesses, least_bits) if h else [] for t, h in zip(column, hint, strict=True)]
        return pa.array([[dict(zip(SPAN.names, s, strict=True)) for s in row] for row in rows], kind)

    return told.asNondeterministic()(text)


def named(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, stop, bits) of every document."""
    return docs.select("doc_id", spans("text").alias("spans"))
