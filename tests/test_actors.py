import pytest
from pyspark.sql import functions as F

from rallylens.operators import actors
from rallylens.rules import decisions, packs
from rallylens.sources.incidents import incidents

FIELDS = "id int, actor1 string, actor2 string, assoc_actor_1 string, assoc_actor_2 string"
ROWS = [
    (1, "members of Antifa [North];  BLM: Black Lives Matter", None, None, None),
    (2, "Green Tide;; Sea Watch ", "National Rally", None, "Oxfam [Paris]"),
    (3, None, "members of The Republicans; members of Antifa", "Renaissance", None),
    (4, None, None, None, None),
    (5, "Protesters (France)", None, "Palestinian Group (France)", None),
    (6, "Protesters (France)", None, "Palestinian Group (France)", None),
    (7, ";;", None, "Renaissance", None),
    (8, "GJ: Yellow Vests", "National Rally", None, None),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, FIELDS)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dictionary(events):
    names = {r.actor_clean: r.actor_clean_lower for r in actors.actor_dictionary(events).collect()}
    assert "Antifa" in names and "members of Antifa" in names and "Sea Watch" in names
    assert "" not in names and None not in names
    assert names["GJ: Yellow Vests"] == "gj: yellow vests"


def test_unknown_is_the_rest(events):
    out = actors.label_dictionary(actors.actor_dictionary(events), packs.SMALL_PACK)
    assert out.where("unknown <> 1 - greatest(left, right, centre)").count() == 0


def test_all_ways_give_the_same_flags(events):
    dictionary = actors.label_dictionary(actors.actor_dictionary(events), packs.SMALL_PACK)
    by_rules = actors.map_partisanship(events, packs.SMALL_PACK)
    order = by_rules.columns
    want = collected(by_rules)
    assert len(want) == len(ROWS)
    for other in (
        actors.map_partisanship(events, packs.SMALL_PACK, limit=0),
        actors.map_partisanship(events, dictionary=dictionary),
        actors.map_partisanship(events, dictionary=dictionary, limit=0),
        actors.inline_field_flags(events, packs.SMALL_PACK),
    ):
        assert collected(other.select(order)) == want


def test_packs_by_country(events):
    placed = events.withColumn("country", F.when(F.col("id") < 4, "A").when(F.col("id") < 8, "B"))
    only_right = [r for r in packs.SMALL_PACK if r.label == "right"]
    by_country = {"A": packs.SMALL_PACK, "B": only_right}
    one = actors.map_partisanship(placed, by_country, scope="country")
    two = actors.map_partisanship(placed, by_country, scope="country", limit=0)
    assert collected(one) == collected(two.select(one.columns))
    got = {r.id: r.event_partisan_type for r in actors.event_partisanship(one).collect()}
    assert (got[2], got[7], got[8]) == ("left_vs_right", "unknown", "unknown")


def test_event_types(events):
    out = actors.classify_events(events, packs.SMALL_PACK)
    got = {r.id: r.event_partisan_type for r in out.collect()}
    assert got == {
        1: "left_only", 2: "left_vs_right", 3: "left_vs_right", 4: "unknown", 5: "unknown", 6: "unknown",
        7: "centre_only", 8: "right_vs_centre",
    }
    row = out.where("id = 4").first()
    assert row.actor1_unknown == 1 and row.event_left == 0


def test_corrected_dictionary_wins(spark, events):
    dictionary = spark.createDataFrame(
        [("Protesters (France)", 0, 1, 0, 0)], "actor_clean string, left int, right int, centre int, unknown int"
    )
    out = actors.classify_events(events, dictionary=dictionary)
    got = {r.id: r.event_partisan_type for r in out.collect()}
    assert got[5] == got[6] == "right_only" and got[1] == "unknown"


def test_stage_coverage_is_cumulative(events):
    rows = actors.stage_coverage(actors.actor_dictionary(events), packs.SMALL_PACK).orderBy("stage_no").collect()
    counts = [r.classified for r in rows]
    assert counts == sorted(counts) and len({r.classified + r.unknown for r in rows}) == 1
    assert [r.stage for r in rows] == list(packs.STAGES)


def test_family_lean(spark):
    leans = spark.createDataFrame(list(packs.PARTY_FAMILIES), "family int, name string, lean string")
    df = spark.createDataFrame([(1, 3), (2, 9), (3, 7), (4, 12), (5, 99), (6, None)], "id int, f int")
    got = {r.id: r.lean for r in actors.lean_of_family(df, "f", leans).collect()}
    assert got == {1: "left", 2: "right", 3: "centre", 4: "unknown", 5: "unknown", 6: "unknown"}


def test_override_and_drop(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, label string")
    fix = spark.createDataFrame([("b", "z")], "k string, corrected string")
    assert collected(actors.override_labels(df, fix, "k", "label")) == [("a", "x"), ("b", "z")]
    wide = df.withColumn("a_partisan", F.lit(1))
    assert actors.drop_suffix(wide, "_partisan").columns == ["k", "label"]


def test_type_counts_on_given_tables(spark, sf):
    typed = actors.classify_events(incidents(spark, sf), packs.SMALL_PACK)
    got = {r.event_partisan_type: r["count"] for r in typed.groupBy("event_partisan_type").count().collect()}
    assert got == {
        "left_only": 420, "unknown": 339, "left_vs_right": 278, "right_only": 180, "centre_only": 171,
        "left_vs_centre": 70, "right_vs_centre": 42,
    }


def test_presence_counts_on_given_tables(spark, sf):
    stepped = decisions.police_presence(incidents(spark, sf))
    got = {r.presence_step: r["count"] for r in stepped.groupBy("presence_step").count().collect()}
    assert got == {
        "0": 264, "1a": 89, "1b": 66, "2": 83, "3": 83, "4": 83, "5": 334, "6": 105, "7": 131, "none": 262,
    }
