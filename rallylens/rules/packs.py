"""Rule tables: plain data, read by the compilers next door.

The rules are parameters.  A label pack can be a list of ``LabelRule`` or a
CSV table with the columns ``pack,label,kind,pattern,unless,stage``; the large
packs of the countries are meant to be kept in such a table and passed in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

LABELS = ("left", "right", "centre")
STAGES = ("government", "party", "objective", "union")
KINDS = ("eq", "regex", "regex_not")


@dataclass(frozen=True)
class LabelRule:
    """Sets ``label`` on a name.

    ``eq`` compares the clean name exactly; ``regex`` searches the lower-cased
    name; ``regex_not`` also demands that ``unless`` is not found in it.
    """

    label: str
    kind: str
    pattern: str
    unless: str | None = None
    stage: str = "party"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown rule kind {self.kind!r}")
        if self.label not in LABELS:
            raise ValueError(f"unknown label {self.label!r}")
        if (self.kind == "regex_not") != bool(self.unless):
            raise ValueError("regex_not, and only regex_not, needs 'unless'")


@dataclass(frozen=True)
class FieldTest:
    """A condition on one column: ``eq`` or ``regex`` (ignoring case)."""

    column: str
    op: str
    value: str


@dataclass(frozen=True)
class Step:
    """One step of an ordered decision; the first step that holds decides.

    ``needs`` lists plain texts of which a text must contain at least one for
    any pattern to match; it only saves work, and may be left out.
    """

    name: str
    result: bool
    patterns: tuple[str, ...] = ()
    tests: tuple[FieldTest, ...] = field(default=())
    needs: tuple[str, ...] = ()


PACK_SCHEMA = "pack string, label string, kind string, pattern string, unless string, stage string"


def packs_from_table(table: DataFrame) -> dict[str, list[LabelRule]]:
    """Rules by pack.  Every rule becomes part of one expression, so they meet on the driver.

    A table of exact names alone may have any size and needs no pack: see
    ``actors.label_by_table``.
    """
    rows = table.select("pack", "label", "kind", "pattern", "unless", "stage").collect()
    packs: dict[str, list[LabelRule]] = {}
    for r in rows:
        packs.setdefault(r.pack, []).append(LabelRule(r.label, r.kind, r.pattern, r.unless, r.stage or "party"))
    return packs


def pack_rows(packs: Mapping[str, Sequence[LabelRule]]) -> list[tuple]:
    """Packs as rows of a rule table."""
    return [(name, r.label, r.kind, r.pattern, r.unless, r.stage) for name, rules in packs.items() for r in rules]


def read_label_packs(spark: SparkSession, path: str) -> dict[str, list[LabelRule]]:
    """Packs of a CSV table, for example one pack per country."""
    table = spark.read.schema(PACK_SCHEMA).csv(path, header=True, nullValue="NA", escape='"')
    return packs_from_table(table)


# A small label pack of our own.  The palestinian-group rule never fires: its
# parentheses are a regex group, which is kept on purpose as the default.
SMALL_PACK = (
    LabelRule("right", "eq", "Government of France (2017-)", stage="government"),
    LabelRule("right", "regex", "national rally|the republicans", stage="party"),
    LabelRule("left", "regex", "socialist party", stage="party"),
    LabelRule("left", "regex_not", "labour", unless="liberal", stage="party"),
    LabelRule("centre", "regex", "renaissance", stage="party"),
    LabelRule("left", "regex", "antifa|black lives matter|green tide|sos racism|oxfam", stage="objective"),
    LabelRule("left", "regex", "palestinian group (france)", stage="objective"),
    LabelRule("centre", "regex", "yellow vests", stage="objective"),
    LabelRule("left", "regex", "general confederation|verdi|workers' commissions|unison|cgil", stage="union"),
)

# Small packs of our own, one for each country of the fixture.
COUNTRY_PACKS = {
    "France": (
        LabelRule("right", "eq", "Government of France (2017-)", stage="government"),
        LabelRule("right", "regex", "national rally|the republicans"),
        LabelRule("left", "regex", "socialist party|unbowed"),
        LabelRule("centre", "regex", "renaissance"),
        LabelRule("left", "regex", "sos racism|green tide", stage="objective"),
        LabelRule("left", "regex", "general confederation|solidaires", stage="union"),
    ),
    "Germany": (
        LabelRule("right", "regex", "national rally|alternative"),
        LabelRule("left", "regex", "socialist party|the greens"),
        LabelRule("left", "regex", "antifa|sea watch", stage="objective"),
        LabelRule("left", "regex", "verdi|metalworkers", stage="union"),
    ),
    "Italy": (
        LabelRule("right", "regex", "national rally|brothers of italy|league"),
        LabelRule("centre", "regex", "renaissance|five star"),
        LabelRule("left", "regex", "oxfam|sea watch", stage="objective"),
        LabelRule("left", "regex", "cgil", stage="union"),
    ),
    "Spain": (
        LabelRule("right", "regex", "the republicans|vox"),
        LabelRule("left", "regex", "socialist party"),
        LabelRule("left", "regex", "green tide|black lives matter", stage="objective"),
        LabelRule("left", "regex", "workers' commissions", stage="union"),
    ),
    "United Kingdom": (
        LabelRule("left", "regex_not", "labour", unless="liberal"),
        LabelRule("right", "regex", "conservative|reform"),
        LabelRule("centre", "regex", "liberal"),
        LabelRule("left", "regex", "oxfam|black lives matter", stage="objective"),
        LabelRule("left", "regex", "unison", stage="union"),
    ),
}

# Party family number to lean.
PARTY_FAMILIES = (
    (1, "Communists/Left Socialists", "left"),
    (2, "Social Democrats", "left"),
    (3, "Greens", "left"),
    (4, "Christian Democrats", "right"),
    (5, "Conservative", "right"),
    (6, "Liberals", "centre"),
    (7, "Agrarian", "centre"),
    (8, "Right-wing populists", "right"),
    (9, "Far right", "right"),
    (10, "Regionalist", "unknown"),
    (11, "Ethnic", "unknown"),
    (12, "Confessional", "unknown"),
    (13, "Other", "unknown"),
)

# The shortest note worth reading.
MIN_NOTE_LENGTH = 10

# The ordered police-presence patterns, matched against the
# lower-cased note.  Patterns with capitals therefore never match; the
# published results depend on that, so it stays.
PRESENCE_STEPS = (
    Step(
        "1a",
        False,
        (
            "police officers?.*(gathered|demonstrated|protested|rallied|marched|dropped their)",
            "officers?.*(gathered|demonstrated|protested|rallied).*(in front of|at|outside)",
            "police (union|forces?).*(protested|demonstrated|gathered)",
            "police.*dropped.*(their )?handcuffs",
            "JUSAPOL",
        ),
        needs=("police", "officer", "JUSAPOL"),
    ),
    Step(
        "1b",
        False,
        tests=(
            FieldTest("actor1", "regex", "Police Forces"),
            FieldTest("interaction", "eq", "Protesters only"),
        ),
    ),
    Step(
        "2",
        False,
        (
            "protest.*against police (brutality|violence|reform)",
            "demonstrat.*against police",
            "denounced.*police brutality",
            r"in (solidarity with|response to|view of).*(protest|death).*in (the )?(United States|U\.S\.|US|Serbia|Iran|Belarus)",
            "after.*death.*by.*police officer in (the )?(United States|America|US)",
            "black lives matter.*(in the United States|after.*killing.*United States)",
            "police brutality.*(in|after).*(United States|America)",
        ),
        needs=("police", "black lives matter", "solidarity with", "response to", "view of"),
    ),
    Step(
        "3",
        False,
        (
            "prohibit.*publication.*police custody",
            "amendment.*police custody",
            "law.*would prohibit.*custody",
            "against.*law.*custody orders",
        ),
        needs=("custody",),
    ),
    Step(
        "4",
        False,
        (
            "no report of.*police intervention",
            "no police intervention",
            "without.*police intervention",
            "police did not intervene",
        ),
        needs=("police",),
    ),
    Step(
        "5",
        True,
        (
            "police (intervened|intervention|dispersed|dispersing)",
            "police.*removed.*demonstrators",
            "police.*used (tear gas|water cannon|pepper spray)",
            "officers? (intervened|dispersed|removed|deployed)",
            "(tear gas|water cannon|pepper spray) (was|were) used",
            "police.*physically.*(remove|removed)",
            "police.*blocked.*(access|entrance|road|demonstrators)",
            "police.*arrested.*(demonstrators|protesters)",
            "police.*detained.*(protesters|demonstrators)",
            r"\d+.*arrested (by police|on site)",
            "scuffles?.*(with|between).*police",
            "clashed with police",
            "police charged.*protesters",
            "baton charge",
            "police cordon",
            "kettled|kettling",
            "police formed.*cordon",
        ),
        needs=("police", "officer", "arrested", " used", "baton charge", "kettl"),
    ),
    Step("6", True, tests=(FieldTest("interaction", "regex", "State forces"),)),
    Step(
        "7",
        True,
        (
            "police presence",
            "police (were|was) present",
            "escorted by police",
            "police escort",
            "police monitored",
            "police observed",
            "riot police.*deployed",
        ),
        needs=("police",),
    ),
)

# A decision pack of our own for invented prose.
PROSE_STEPS = (
    Step("exclude", False, ("licen[sc]e",)),
    Step("strong", True, ("the.*and",)),
    Step("field", True, tests=(FieldTest("source", "eq", "src1"),)),
    Step("weak", True, ("ion",)),
)

# Small ideology keys of our own: one key twice (it counts twice) and one
# hyphenated key (it cannot match text whose punctuation was removed).
SMALL_LEFT_KEYS = ("socialist", "workers", "union", "climate", "solidarity", "anti-fascist")
SMALL_RIGHT_KEYS = ("nationalist", "patriotic", "brexit", "nationalist")

# The ideology keywords of the published lexicon.
LEFT_KEYS = (
    "socialist", "communist", "labour", "workers", "union", "leftist", "marxist",
    "antifa", "anti-fascist", "anarchist", "progressive", "climate", "environmental",
    "extinction rebellion", "lgbt", "lgbtq", "trans", "feminist", "blm", "black lives matter",
    "social justice", "anti-capitalist", "occupy", "activism", "green", "greenpeace", "migrant",
    "refugee", "solidarity", "anticapitalist", "anti racist", "antiracist", "anti war",
    "antiwar", "woke", "pro-choice", "queer", "pro-palestine", "pro palestine", "liberal",
)
RIGHT_KEYS = (
    "nationalist", "conservative", "tory", "traditionalist", "patriot", "libertarian",
    "far-right", "alt-right", "anti-immigration", "brexiteer", "brexit", "ukip", "bnp",
    "anti-eu", "anti-islam", "anti-muslim", "anti-lgbtq", "religious conservative",
    "anti-woke", "pro-life", "identitarian", "nationalist", "pro-britain", "patriotic",
    "anti-refugee", "anti-migrant", "ethnonationalist", "white nationalist", "edl",
    "tommy robinson", "national front", "britain first", "reform", "capitalist",
)

# Keywords of any police response, found inside words too.
RESPONSE_KEYS = (
    "arrest", "beat", "brutal", "coerce", "coercion", "detain",
    "harm", "hurt", "injure", "injury", "kill", "killed",
)

# Own short stop list.
STOP_WORDS = ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by")
