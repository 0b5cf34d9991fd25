"""Personal data: regular expressions propose, checksums confirm, context scores.

Every kind proposes leftmost, non-overlapping spans over a whole text.  Card
numbers must pass Luhn, account numbers (IBAN) mod-97, address parts and digit
counts their ranges; what fails is dropped and not tried again.  Only account
numbers are proposed by their first four characters and take the longest run of
whole words that passes, so words behind a number do not hide it.  Words near a
span raise its score.  The four base kinds stay whatever their score; the added
kinds (iban, ssn) stay from ``THRESHOLD`` on.

Everything is column expressions over one row, so nothing is shuffled.  A text
is split at the matches of a kind once; starts are sums over the pieces, taken
in blocks so that a text with many matches stays near linear.  Repetitions are
possessive, so no text makes the patterns backtrack or recurse deeply.

Defined results: a null text is empty and has no spans; offsets are code
points, ends exclusive; repeated rows are each answered; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallylens.llm.tables import unused

THRESHOLD = 0.6
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
LEAST_MATCH = 4  # no pattern takes fewer characters


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def sums_before(values: Column, block: int = 64) -> Column:
    """For every entry the sum of the entries before it."""

    def at(v: Column, heads: Column) -> Column:
        return F.transform(v, lambda _, i: F.get(heads, F.floor(i / block).cast("int")) + total(F.slice(v, i - i % block + 1, i % block)))

    def heads(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        return let(F.transform(numbers, lambda k: total(F.slice(v, k * block + 1, F.lit(block)))), lambda s: F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k))))

    return F.when(F.size(values) == 0, values).otherwise(let(values, lambda v: let(heads(v), lambda h: at(v, h))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Whether an account number's remainder is 1, letters counting from 10."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    code = F.transform(F.split(moved, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    left = F.aggregate(code, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return left == 1


def account(run: Column) -> Column:
    """The longest word-bounded account number a text starts with; empty if none passes."""

    def longest(words: Column) -> Column:
        numbers = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
        return F.get(F.filter(numbers, lambda v: v.rlike(f"^{ACCOUNT}$") & mod97(v)), F.lit(0))

    return F.coalesce(let(F.split(F.regexp_extract(run, rf"^{ACCOUNT}\b", 0), " "), longest), F.lit(""))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    present: Callable[[Column], Column]  # a quick test that rules most texts out
    valid: Callable[[Column], Column]
    score: float
    words: str  # context, any of these
    base: bool = True
    whole: Callable[[Column], Column] | None = None  # the value in a match and what follows it
    reach: int = 0  # so many characters at most


LOCAL = "[A-Za-z0-9._%+-]"
PART = "(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"  # whole runs of 16 to 19 digits
ACCOUNT = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11,30}\b)"  # the head; account() finds the end
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
KINDS = [
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True), 0.7, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), 0.5, "ip|host|server|address|adresse|direcci"),
    Kind("card", CARD, lambda t: t.rlike(CARD), lambda v: F.call_function("luhn_check", digits(v)), 0.6, "card|visa|karte|tarjeta|carte|credit"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda v: F.length(digits(v)).between(8, 15), 0.6, "phone|tel|call|fax|mobil"),
    Kind("iban", IBAN, lambda t: t.rlike(IBAN), lambda v: v != "", 0.7, "iban|bank|konto|account|cuenta|compte", False, account, 61),
    Kind("ssn", SSN, lambda t: t.rlike(SSN), lambda v: ~v.rlike("^(000|666|9)"), 0.4, "ssn|social security", False),
]
BASE = [k.name for k in KINDS if k.base]
SPANS = "array<struct<kind:string,start:int,stop:int,score:double,value:string>>"


def apart(found: Column) -> Column:
    """Spans in order without those that begin inside an earlier one."""
    step = lambda kept, s: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["stop"] > s["start"], F.lit(False)), kept).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(found, F.array().cast(SPANS), step)


def kind_spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind with their scores."""
    room = CONTEXT_CHARS + kind.reach

    def placed(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
        tails = F.transform(found, lambda m, i: F.right(F.concat(F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)), m), F.lit(CONTEXT_CHARS)))
        heads = F.transform(found, lambda m, i: F.left(F.concat(m, F.left(F.get(gaps, i + 1), F.lit(room))), F.lit(room)))
        return let(tails, lambda t: let(heads, lambda h: confirmed(gaps, found, sums_before(steps), t, h)))

    def confirmed(gaps: Column, found: Column, befores: Column, tails: Column, heads: Column) -> Column:
        def span(before: Column, i: Column) -> Column:
            match, gap = F.get(found, i), F.get(gaps, i)
            start = before + F.length(gap)
            # the text on both sides, over other matches too: each has LEAST_MATCH characters or more
            n = CONTEXT_CHARS // LEAST_MATCH
            left = F.right(F.concat(F.array_join(F.slice(tails, F.greatest(i - n + 1, F.lit(1)), F.least(i, F.lit(n))), ""), F.right(gap, F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
            after = F.left(F.concat(F.left(F.get(gaps, i + 1), F.lit(room)), F.array_join(F.slice(heads, i + 2, F.lit(room // LEAST_MATCH + 1)), "")), F.lit(room))

            def scored(value: Column, right: Column) -> Column:
                near = F.lower(F.concat_ws(" ", left, right))
                score = F.lit(kind.score) + F.when(near.rlike(f"(^|[^a-z])({kind.words})"), CONTEXT_BONUS).otherwise(0.0)
                return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(value)).alias("stop"), score.alias("score"), value.alias("value"))

            if kind.whole is None:
                return scored(match, after)
            beyond = F.concat(match, after)
            return let(kind.whole(beyond), lambda v: scored(v, F.substr(beyond, F.length(v) + 1, F.lit(CONTEXT_CHARS))))

        spans = F.transform(befores, span)
        good = F.filter(spans, lambda s: kind.valid(s["value"]) & (F.lit(kind.base) | (s["score"] >= THRESHOLD)))
        return good if kind.whole is None else apart(good)

    found = let(F.split(text, kind.pattern, -1), lambda g: let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda m: placed(g, m)))
    return F.when(kind.present(text), found).otherwise(F.array().cast(SPANS))


def spans(text: Column | str) -> Column:
    """All spans of a text, by kind as listed, then by start."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.concat(*[kind_spans(whole, k) for k in KINDS])


def named(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, stop, score, value) of every document."""
    return docs.select("doc_id", spans("text").alias("spans"))


def masked(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``[KIND]``."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        more = F.array(F.substr(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))), F.when(s["start"] < done["at"], "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), F.when(s["stop"] > done["at"], F.concat(done["parts"], more)).otherwise(done["parts"]).alias("parts"))

    joined = F.aggregate(order, begin, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substr(text, done["at"] + 1)))
    return F.when(F.size(found) == 0, text).otherwise(joined)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their personal data masked; a null text stays null."""
    found = unused(docs, "spans")
    told = docs.withColumn(found, spans("text"))
    return told.withColumn("text", F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col(found)))).select(*docs.columns)
