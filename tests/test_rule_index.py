import random

import pytest
from pyspark.sql import functions as F

from rallylens.rules import index, packs
from rallylens.rules.labels import label_flags

SCHEMA = "label string, kind string, pattern string, unless string"


@pytest.mark.parametrize(
    "pattern,piece",
    [("abcd.ef", "abcd"), ("colou?r tv", "r tv"), ("ab+cde", "cde"), ("a|b", ""), ("group (france)", ""), ("^the party$", "the party"), (r"ver\.di union", "di union"), ("[ab]cdef[0-9]*x", "cdef"), (r"\bword", ""), ("x{2}abc", ""), ("", "")],
)
def test_needed_pieces(spark, pattern, piece):
    df = spark.createDataFrame([(pattern,)], "p string")
    assert df.select(index.needed(F.col("p")).alias("x")).first().x == piece


def test_index_equals_the_expression(spark):
    """Many made rules of every kind on made names, against the rules as one expression."""
    rng = random.Random(3)
    syllables = ["par", "ti", "ver.", "di", "uni", "on", " ", "left", "rouge", "é", "gr", "oup", "(x)"]
    names = ["".join(rng.choices(syllables, k=rng.randint(1, 6))).title() for _ in range(400)] + [None, "", "ab", "Government of France (2017-)"]
    rows = [(r.label, r.kind, r.pattern, r.unless) for r in packs.SMALL_PACK]
    for _ in range(150):
        word = "".join(rng.choices(syllables[:-1], k=rng.randint(1, 4)))
        kind = rng.choice(["regex", "regex", "regex_not", "eq"])
        pattern = rng.choice([word, f"{word}|{word[::-1]}", f"^{word}", f"{word}.?on", f"({word})+"]) if kind != "eq" else rng.choice(names[:400])
        rows.append((rng.choice(packs.LABELS), kind, pattern, rng.choice(["ti", "on$"]) if kind == "regex_not" else None))
    df = spark.createDataFrame([(n,) for n in names], "actor_clean string")
    got = {r[0]: tuple(r[1:4]) for r in index.label_names(df, spark.createDataFrame(rows, SCHEMA)).collect()}
    plain = df.where("actor_clean is not null").distinct().select("actor_clean", *[c.alias(k) for k, c in label_flags("actor_clean", [packs.LabelRule(*r[:3], r[3]) for r in rows]).items()])
    assert got == {r[0]: tuple(r[1:]) for r in plain.collect()} and any(sum(v) for v in got.values())


def test_too_many_free_rules_and_no_rules(spark, monkeypatch):
    names = spark.createDataFrame([("ab",), ("b",)], "actor_clean string")
    rules = spark.createDataFrame([("left", "regex", "a.", None), ("left", "regex", "b", None)], SCHEMA)
    assert sorted(tuple(r) for r in index.label_names(names, rules.limit(0)).collect()) == [("ab", 0, 0, 0, 1), ("b", 0, 0, 0, 1)]
    assert sorted(tuple(r) for r in index.label_names(names, rules).collect()) == [("ab", 1, 0, 0, 0), ("b", 1, 0, 0, 0)]
    monkeypatch.setattr(index, "MOST_FREE", 1)
    with pytest.raises(ValueError):
        index.label_names(names, rules)


def test_a_piece_every_name_shares_does_not_bring_them_together(spark):
    """Rules of one common piece and one of their own meet a name or two each, not every name."""
    names = spark.createDataFrame([(f"Customer#{i:06} ring",) for i in range(300)], "actor_clean string")
    rules = spark.createDataFrame([("left", "regex", f"^customer#[0-9]*{i:05} .*g", None) for i in range(0, 300, 3)], SCHEMA)
    keys = index.rule_keys(index.indexed(rules))
    posted = names.select("actor_clean", F.explode(index.name_keys(F.lower("actor_clean"))).alias("key"))
    chosen = index.keyed(keys, posted)
    assert chosen.count() == 100 and chosen.join(posted, "key").count() < 100 * 12
    assert index.label_names(names, rules).agg(F.sum("left")).first()[0] == 100
