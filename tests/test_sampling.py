import hashlib

import pytest
from pyspark.sql import functions as F

from rallylens.operators import sampling


def in_order(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("n, fraction", [(0, 0.1), (4, 0.1), (25, 0.1), (1000, 0.1), (1000, 1.0), (37, 0.5)])
def test_fraction_is_exact(spark, n, fraction):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r.k for r in sampling.sample_fraction(df, fraction, "k", 7).collect()}
    assert got == set(in_order(range(n), 7)[: round(n * fraction)])


def test_narrowing_rounds(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LAST_ROUND", 1)
    monkeypatch.setattr(sampling, "PREFIX", 1)
    df = spark.range(500).withColumnRenamed("id", "k")
    got = {r.k for r in sampling.sample_fraction(df, 0.3, "k", 3).collect()}
    assert got == set(in_order(range(500), 3)[:150])


def test_every_sample_is_a_filter(spark):
    df = spark.range(400).withColumnRenamed("id", "k")
    got = sampling.sample_rows(df, 60, "k", 3)
    assert {r.k for r in got.collect()} == set(in_order(range(400), 3)[:60])
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    assert sampling.sample_rows(df, 1000, "k", 3).count() == 400


def test_layout_does_not_matter(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    picks = [
        sorted(r.k for r in sampling.sample_fraction(df.repartition(p), 0.2, "k").collect()) for p in (1, 7)
    ]
    assert picks[0] == picks[1]


def test_copies_stay_together(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    split = sampling.train_test_flag(df, 0.2, "k")
    assert split.groupBy("k").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0


def test_repeated_keys_follow_one_rule(spark):
    twice = spark.range(20_100).select((F.col("id") % 10_050).alias("k"))
    assert [sampling.sample_rows(twice, n, "k").count() for n in (5, 6, 9_999, 10_001)] == [6, 6, 10_000, 10_002]


def test_split_sizes(spark):
    df = spark.range(399).withColumnRenamed("id", "doc_id")
    assert sampling.train_test_flag(df, 0.2, "doc_id").where("is_test").count() == 80


def test_rows_and_groups(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).alias("g"))
    assert {r.k for r in sampling.sample_rows(df, 5, "k", 1).collect()} == set(in_order(range(100), 1)[:5])
    assert sampling.sample_rows(df, 500, "k").count() == 100
    per = sampling.sample_per_group(df, "g", 3, "k", 1)
    assert {r["count"] for r in per.groupBy("g").count().collect()} == {3}
    assert "WindowGroupLimit" in per._jdf.queryExecution().executedPlan().toString()


def test_dense_ids(spark):
    df = spark.range(777).withColumnRenamed("id", "k")
    for prefix in (1, 4):
        rows = sampling.dense_id(df, "k", seed=0, prefix=prefix).collect()
        assert [r.k for r in sorted(rows, key=lambda r: r.row_id)] == in_order(range(777), 0)
        assert sorted(r.row_id for r in rows) == list(range(1, 778))
