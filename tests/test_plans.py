"""What the optimised plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from rallylens.operators import actors
from rallylens.plans import queries as q
from rallylens.rules import decisions, packs
from rallylens.sources.incidents import reported, table


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["presence_type_topk", "keyword_response", "filter_regex", "presence_by_country"])
def test_rules_run_when_the_query_does(spark, sf, name):
    assert "RLIKE" in plan_of(q.QUERIES[name](spark, sf)).upper()


def test_text_is_lowered_once_under_a_filter(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text", "source")
    kept = decisions.decide(documents, "text", packs.PROSE_STEPS, "presence").where("presence").select("doc_id")
    assert plan_of(kept).count("lower(") == 1


def test_names_are_cleaned_once_under_a_filter(spark, sf):
    assert plan_of(q.unclassified_events(spark, sf)).count("regexp_replace") <= 2 * 3


def test_patterns_are_searched_in_distinct_notes(spark, sf):
    """The notes are grouped below the search, so equal notes are searched once."""
    df = q.presence_pattern_hits(spark, sf)
    plan = plan_of(df).upper()
    assert plan.count("AGGREGATE [NOTES") == 1 and plan.index("RLIKE") < plan.index("AGGREGATE [NOTES")
    assert [t for _, t in df.dtypes] == ["string", "string", "bigint"]


@pytest.mark.parametrize("name", ["context_ideology", "final_ideology", "ideology_share"])
def test_keywords_are_searched_once_in_equal_notes(spark, sf, name):
    """Hits of frequent notes come from a broadcast table; events that name no keyword query are not joined to it."""
    assert "__known" in plan_of(q.QUERIES[name](spark, sf)) and "strategy=broadcast" in plan_of(q.QUERIES[name](spark, sf))
    assert "__known" not in plan_of(q.actor_ideology(spark, sf))


def test_steps_and_patterns_fire(spark, sf):
    hits = q.presence_pattern_hits(spark, sf).collect()
    assert {r.step for r in hits if r.n} == {s.name for s in packs.PRESENCE_STEPS if s.patterns}
    assert sum(r.n > 0 for r in hits) >= 22
    steps = {r.presence_step for r in q.presence_step_counts(spark, sf).collect()}
    assert steps == {"0", "none"} | {s.name for s in packs.PRESENCE_STEPS}


def test_many_names(spark, sf):
    assert actors.actor_dictionary(reported(spark, sf)).count() > 25


def test_label_table_of_any_size_is_a_join(spark):
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "actor_clean string")
    exact = spark.createDataFrame([("A", "left"), ("A", "centre"), ("B", "right"), ("Z", "left")], "pattern string, label string")
    got = {r.actor_clean: (r.left, r.right, r.centre, r.unknown) for r in actors.label_by_table(names, exact).collect()}
    assert got == {"A": (1, 0, 1, 0), "B": (0, 1, 0, 0), "C": (0, 0, 0, 1)}


def test_steps_are_searched_once_in_equal_notes(spark, sf):
    """Frequent notes bring what the steps found in them; rare, long and missing notes are searched in their own rows."""
    events = reported(spark, sf)
    twice = events.unionByName(events.where("year % 2 = 0")).withColumn("notes", F.when(F.col("fatalities").isNull(), F.repeat("notes", 30)).otherwise(F.col("notes")))
    columns = ["event_id_cnty", "notes", "presence_step", "police_presence"]
    plain = decisions.police_presence(twice).select(columns)
    looked_up = decisions.police_presence(twice, counted=twice).select(columns)
    assert plain.exceptAll(looked_up).count() == 0 and looked_up.exceptAll(plain).count() == 0
    plan = plan_of(q.presence_rule(spark, sf))
    assert "__known" in plan and "strategy=broadcast" in plan
