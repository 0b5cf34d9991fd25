import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rallylens.rules import decisions, keywords, labels, packs
from rallylens.rules.packs import LabelRule


def flags(spark, name, rules=packs.SMALL_PACK):
    df = spark.createDataFrame([(name,)], "n string")
    row = df.select(*[c.alias(k) for k, c in labels.label_flags("n", rules).items()]).first()
    return row.left, row.right, row.centre


@pytest.mark.parametrize(
    "name, want",
    [
        ("Government of France (2017-)", (0, 1, 0)),
        ("government of france (2017-)", (0, 0, 0)),
        ("Former Government of France (2017-)", (0, 0, 0)),
        ("Palestinian Group (France)", (0, 0, 0)),
        ("Labour Group (France)", (1, 0, 0)),
        ("Liberal Labour Club", (0, 0, 0)),
        ("members of Antifa", (1, 0, 0)),
        ("National Rally against Renaissance and Antifa", (1, 1, 1)),
        ("", (0, 0, 0)),
        (None, (0, 0, 0)),
    ],
)
def test_label_traps(spark, name, want):
    assert flags(spark, name) == want


def test_adding_rules_never_clears_a_flag(spark):
    few = packs.SMALL_PACK[:3]
    for name in ("The Republicans", "Socialist Party", "Renaissance", "Antifa"):
        before, after = flags(spark, name, few), flags(spark, name)
        assert all(a >= b for a, b in zip(after, before))


def test_rules_are_checked():
    with pytest.raises(ValueError):
        LabelRule("left", "regex_not", "a")
    with pytest.raises(ValueError):
        LabelRule("left", "like", "a")
    with pytest.raises(ValueError):
        LabelRule("up", "eq", "a")


def test_pack_from_csv(spark, tmp_path):
    path = tmp_path / "pack.csv"
    path.write_text(
        "pack,label,kind,pattern,unless,stage\n"
        "UK,left,regex_not,labour|labor,liberal,party\n"
        'France,right,eq,"A ""B"", C",NA,government\n'
    )
    assert packs.read_label_packs(spark, str(path)) == {
        "UK": [LabelRule("left", "regex_not", "labour|labor", "liberal", "party")],
        "France": [LabelRule("right", "eq", 'A "B", C', None, "government")],
    }


def step(spark, notes, interaction=None, actor1=None):
    df = spark.createDataFrame([(notes, interaction, actor1)], "notes string, interaction string, actor1 string")
    row = decisions.police_presence(df).first()
    return row.presence_step, row.police_presence


@pytest.mark.parametrize(
    "args, want",
    [
        ((None,), ("0", False)),
        (("  short  ",), ("0", False)),
        (("Police officers gathered outside the hall",), ("1a", False)),
        (("Police used tear gas on them", "Protesters only", "POLICE FORCES of X"), ("1b", False)),
        (("Police used tear gas on them", None, "Police Forces of X"), ("5", True)),
        (("People protest against police brutality",), ("2", False)),
        (("An amendment on police custody",), ("3", False)),
        (("There was no police intervention",), ("4", False)),
        (("12 people were arrested by police",), ("5", True)),
        (("Nothing to see here at all", "state forces-Protesters"), ("6", True)),
        (("Riot police were deployed nearby",), ("7", True)),
        (("Farmers gathered in the centre",), ("none", False)),
        # Patterns with capitals never match the lower-cased note.
        (("A JUSAPOL rally saw police cordon lines",), ("5", True)),
        (("After the death caused by a police officer in the United States",), ("none", False)),
        (("Police came\nand arrested protesters",), ("none", False)),
    ],
)
def test_presence_steps(spark, args, want):
    assert step(spark, *args) == want


def test_all_patterns_are_there():
    assert [len(s.patterns) for s in packs.PRESENCE_STEPS] == [5, 0, 7, 4, 4, 17, 0, 7]
    assert (len(packs.LEFT_KEYS), len(packs.RIGHT_KEYS), len(packs.RESPONSE_KEYS)) == (40, 34, 12)


def test_actor_ideology(evaluate):
    left, right = packs.SMALL_LEFT_KEYS, packs.SMALL_RIGHT_KEYS
    say = keywords.actor_ideology("t", left, right)
    assert evaluate(say, "Socialist and nationalist club") == "Left"
    assert evaluate(say, "nationalists") == "Unclassified"
    assert evaluate(say, "Patriotic youth") == "Right"
    assert evaluate(say, "anti fascist") == "Unclassified"
    assert evaluate(say, "") == "Unclassified"
    assert evaluate(say, None) == "Unclassified"


def test_repeated_key_counts_twice(evaluate):
    right = packs.SMALL_RIGHT_KEYS
    assert evaluate(keywords.keyword_hits("t", right), "nationalist patriotic brexit") == 4
    assert evaluate(keywords.keyword_hits("t", ["white nationalist", "nationalist"]), "white nationalist") == 2
    side = keywords.context_ideology("t", packs.SMALL_LEFT_KEYS, right)
    assert evaluate(side, "socialist workers nationalist") == "Unclassified"
    assert evaluate(side, "socialist union workers nationalist") == "Left"
    assert evaluate(side, "nationalist socialist") == "Right"


def test_words_are_whole_in_any_script(evaluate):
    keys = ["green", "union", "anti-eu", "pro palestine"]
    assert evaluate(keywords.keyword_hits("t", keys), "Green,green;greens évgreen green") == 3
    assert evaluate(keywords.keyword_hits("t", keys), "greené union_ union") == 1
    assert evaluate(keywords.keyword_hits("t", keys), "anti-eu pro palestine, pro  palestine") == 2
    assert evaluate(keywords.keyword_hits("t", keys), None) is None


def test_split_keys_keeps_every_key():
    lists, others = keywords.split_keys(packs.RIGHT_KEYS)
    assert sorted([k for single in lists for k in single] + others) == sorted(packs.RIGHT_KEYS)
    assert all(len(single) == len(set(single)) for single in lists)


def test_final_and_response(spark, evaluate):
    pick = keywords.first_classified(F.lit("Unclassified"), F.lit("Right"), F.lit("Left"))
    assert evaluate(pick, "x") == "Right"
    assert evaluate(keywords.first_classified(F.lit("Unclassified")), "x") == "Unclassified"
    assert evaluate(keywords.response_flag("t"), "Solidarity with a PHARMACY") == 1
    assert evaluate(keywords.response_flag("t"), "nothing") == 0
    assert evaluate(keywords.response_flag("t"), None) == 0


@settings(max_examples=60, deadline=None)
@given(data=st.data())
@pytest.mark.parametrize("number", range(len(packs.PRESENCE_STEPS)))
def test_needs_hold_for_every_match(number, data):
    chosen = packs.PRESENCE_STEPS[number]
    for pattern in chosen.patterns:
        text = data.draw(st.from_regex(pattern, alphabet=st.characters(codec="ascii")))
        assert any(n in text for n in chosen.needs)
