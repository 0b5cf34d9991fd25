import pytest
from pyspark.sql import functions as F

from rallylens.operators.lookup import computed_per_value, hot_keys, known_values, lookup_join, table_bytes


@pytest.fixture
def sides(spark):
    # One key holds a third of the rows, another third has no key.
    left = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))
        ).alias("key"),
    )
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 400)], "key string, v int")
    return left, table


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_both_ways_agree(sides, how):
    left, table = sides
    plain = sorted(map(tuple, left.join(table, "key", how).collect()), key=repr)
    for limit in (1 << 30, 0):
        got = lookup_join(left, table, "key", how, limit=limit)
        assert sorted(map(tuple, got.collect()), key=repr) == plain


def test_hot_key_reaches_many_tasks(sides, spark):
    left, table = sides
    assert [r.key for r in hot_keys(left, ["key"], 10).collect() if r.key] == ["hot"]
    got = lookup_join(left, table, "key", limit=0, rows_per_salt=100).where("key = 'hot'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_equal_rows_are_merged_and_come_back(sides, how):
    left, table = sides
    left = left.select("key")
    plain = sorted(map(tuple, left.join(table, "key", how).collect()), key=repr)
    got = lookup_join(left, table, "key", how, limit=0, merge=True, rows_per_salt=100)
    assert sorted(map(tuple, got.collect()), key=repr) == plain


def test_a_million_equal_rows_end_in_many_tasks(spark):
    words = spark.range(1_000_000, numPartitions=4).select(F.lit("the").alias("word"), (F.col("id") % 997).alias("doc"))
    table = spark.createDataFrame([("the", 1)], "word string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = lookup_join(words, table, "word", "inner", limit=0, merge=True, rows_per_salt=10_000)
        tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 600_000


def test_size_grows_with_the_text(spark):
    small = spark.createDataFrame([("a",)], "k string")
    large = spark.createDataFrame([("a" * 10_000,)], "k string")
    assert table_bytes(large) - table_bytes(small) == 9_999


def test_plan_broadcasts_only_what_fits(sides):
    left, table = sides
    fits = lookup_join(left, table, "key")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in fits


def test_only_frequent_texts_are_computed_beforehand(spark):
    """Rare, long and missing texts compute their own columns; all rows get the same ones either way."""
    texts = ["often"] * 6 + ["twice"] * 2 + ["once", "", "", None, None, "long" * 300, "long" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    made = {"size": F.length("t"), "same": F.when(F.col("t") == "often", None).otherwise(F.upper("t"))}
    known = known_values(df, "t", made, "known")
    assert {r.t for r in known.where("known is not null").collect()} == {"often", "twice", ""}
    got = {(r.id, r.t, r.size, r.same) for r in computed_per_value(df, "t", made).collect()}
    assert got == {tuple(r) for r in df.withColumns(made).collect()}
    assert computed_per_value(df.where("id = 8"), "t", made, df.where("id < 0")).first().size == 4
