import math

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, normal


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, sf):
    assert entry.entry(spark).columns == ["event_partisan_type", "n", "percent"]


def finite(rows):
    return all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))


# What must hold of the fits that SQL has no words for.
HOLDS = {
    "topic_dominant": lambda rows: finite(rows) and all(1 / 3 <= r.gamma <= 1 and r.topic in (1, 2, 3) for r in rows),
    "topic_terms": lambda rows: {t: sum(r.topic == t and r.rank <= 15 for r in rows) >= 15 for t in (1, 2, 3)} == {1: True, 2: True, 3: True},
    "severity_scores": lambda rows: all(0 <= r.quality_score <= 1 and 0 <= r.toxic_score <= 1 for r in rows),
    "response_on_grid": lambda rows: finite(rows) and [r.term for r in rows] == ["(intercept)", "cell_lat", "cell_lon", "month"],
    "presence_logit_fe": lambda rows: finite(rows) and len({r.term for r in rows}) == len(rows),
    "selection_two_step": lambda rows: finite(rows) and rows[-1].term == "mills_ratio",
    "selection_two_step_errors": lambda rows: finite(rows) and rows[-1].term == "mills_ratio" and all(r.std_error > 0 for r in rows),
    "clustered_se": lambda rows: finite(rows) and all(r.std_error > 0 for r in rows),
}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    found = df.collect()
    rows = [tuple(r) for r in found]
    assert rows and HOLDS.get(name, bool)(found)
    sql = entry.oracle_sql().get(name)
    if sql:
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        assert normal(df.columns, rows) == normal(names, result.fetchall())
