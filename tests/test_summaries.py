import math
import random

import datetime

import pytest
from pyspark.sql import functions as F

from rallylens.operators import places, rows, summaries


@pytest.fixture(scope="module")
def events(spark):
    d = datetime.date(2020, 5, 1)
    return spark.createDataFrame(
        [
            (2020, d, "France", "a", None, True, "X"),
            (2020, d, "France", None, None, False, "X"),
            (2021, d, "Spain", "a", 2, False, None),
            (2021, d, "Spain", "a", None, False, None),
            (None, d, None, "b", 1, True, "Y"),
        ],
        "year int, event_date date, country string, location string, fatalities int, police boolean, interaction string",
    )


def test_yearly_nulls(events):
    got = [tuple(r) for r in summaries.yearly_summary(events).collect()]
    assert got == [(None, 1, 1, 1), (2020, 2, 0, 2), (2021, 2, 2, 1)]


def test_frequency_and_share_differ_on_null(events):
    assert {tuple(r) for r in summaries.frequency(events, "country").collect()} == {("France", 2), ("Spain", 2)}
    shares = {r.country: (r.n, r.percent) for r in summaries.share(events, "country").collect()}
    assert shares == {"France": (2, 40.0), "Spain": (2, 40.0), None: (1, 20.0)}


def test_rates(events):
    got = [tuple(r) for r in summaries.rate_by(events, "police", "country").collect()]
    assert got == [(None, 1, 1, 100.0), ("France", 2, 1, 50.0), ("Spain", 2, 0, 0.0)]
    years = [tuple(r) for r in summaries.rate_by_year(events, "police").collect()]
    assert years == [(None, 1, 1, 100.0), (2020, 1, 2, 50.0)]


def test_crosstab_keeps_null_row_and_missing_column(events):
    only_false = events.where("not police")
    got = summaries.crosstab(only_false, "interaction", "police", [False, True], ["absent", "present"])
    assert {tuple(r) for r in got.collect()} == {("X", 1, 0), (None, 2, 0)}


def test_global_and_missing(events):
    wide = events.withColumns({"assoc_actor_1": F.lit(""), "assoc_actor_2": F.lit(None).cast("string")})
    row = summaries.global_stats(wide).first()
    assert (row.total_records, row.countries, row.first_year, row.last_year) == (5, 3, 2020, 2021)
    missing = summaries.missing_counts(wide, "assoc_actor_1", "assoc_actor_2", "location").first()
    assert tuple(missing) == (5, 5, 5, 1)


def test_ties_kept_in_group_and_ordered_in_top(spark):
    df = spark.createDataFrame([("g", "a", 3), ("g", "b", 2), ("g", "c", 2), ("h", "d", 1)], "g string, w string, n int")
    got = {r.w for r in summaries.top_per_group(df, ["g"], "n", 2).collect()}
    assert got == {"a", "b", "c", "d"}
    words = spark.createDataFrame([(w,) for w in "bbaacd"], "w string")
    assert [tuple(r) for r in summaries.top_counts(words, ["w"], 3).collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_stack_and_first(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "id int, x string, y string")
    assert {tuple(r) for r in summaries.stacked(df, ["x", "y"], "f", "v").collect()} == {
        ("x", "a"), ("x", "b"), ("y", "c"),
    }
    assert summaries.first_rows(df, ["id"], 1).first().id == 1


def test_label_totals_and_scores(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (0, 0, 0.51), (1, 0, 0.2), (1, 0, 0.9)], "a int, b int, s double")
    got = {r.label: (r.positive, r.mean) for r in summaries.label_totals(df, ["a", "b"]).collect()}
    assert got == {"a": (3, 0.75), "b": (0, 0.0)}
    row = summaries.score_summary(df, ["s"]).first()
    assert (row.cases, row.share) == (2, 0.5)
    assert summaries.score_summary(df.limit(0), ["s"]).first().share is None


def test_filters_and_unions(spark):
    df = spark.createDataFrame([("a",), (None,), ("",), ("b",)], "c string")
    assert [r.c for r in rows.without_values(df, "c", ["a"]).collect()] == [None, "", "b"]
    assert [r.c for r in rows.with_text(df, "c").collect()] == ["a", "b"]
    one = spark.createDataFrame([(1, "x")], "id int, s string")
    two = spark.createDataFrame([(2,)], "id int")
    tagged = rows.stack_tagged({"p": one, "q": two}, "src")
    assert {tuple(r) for r in tagged.select("id", "s", "src").collect()} == {(1, "x", "p"), (2, None, "q")}
    assert rows.stack_tables([one, one.select("s", "id")]).count() == 2
    with pytest.raises(Exception):
        rows.stack_tables([one, two]).count()


def test_places(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 91.0)], "latitude double, longitude double")
    sites = spark.createDataFrame([(0.0, 1.0), (0.0, 90.0), (None, 0.0)], df.schema)
    got = {r.longitude: r.distance_km for r in places.nearest_site_distance(df, sites).collect()}
    assert got == pytest.approx({0.0: 111.195, 91.0: 111.195}, abs=0.01)
    assert [r.distance_km for r in places.nearest_site_distance(df, sites.limit(0)).collect()] == [None, None]


def test_nearest_site_is_certain_anywhere(spark):
    rng = random.Random(6)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(89.9, 0.0), (0.0, 179.9), (-90.0, 0.0), (50.0, 2.0)]
    sites = [(rng.uniform(-60, 75), rng.uniform(-180, 180)) for _ in range(15)] + [(0.0, -179.9), (89.0, 170.0)]
    named = "latitude double, longitude double"
    df = spark.createDataFrame([*spots, spots[0]], named).union(spark.createDataFrame([(None, 1.0)], named))
    got = places.nearest_site_distance(df, spark.createDataFrame(sites, named)).collect()

    def km(a, b):
        la, lo, sa, so = map(math.radians, (*a, *b))
        h = math.sin((sa - la) / 2) ** 2 + math.cos(la) * math.cos(sa) * math.sin((so - lo) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    assert len(got) == len(spots) + 2
    for r in got:
        if r.latitude is not None:
            assert r.distance_km == pytest.approx(min(km((r.latitude, r.longitude), s) for s in sites), abs=1e-6)


def km_to_arc(p, a, b, steps=4000):
    """Distance to an arc by walking along it."""

    def v(q):
        la, lo = map(math.radians, q)
        return (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la))

    p, a, b = v(p), v(a), v(b)
    best = math.pi
    for i in range(steps + 1):
        f = i / steps
        m = [(1 - f) * x + f * y for x, y in zip(a, b)]
        n = math.sqrt(sum(x * x for x in m))
        best = min(best, math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(p, m)) / n))))
    return 6371 * best


def test_nearest_road_over_poles_date_line_and_dense_cells(spark):
    rng = random.Random(8)
    roads = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(12)]
    roads = [(la, lo, la + rng.uniform(-9, 9), lo + rng.uniform(-40, 40)) for la, lo in roads]
    roads += [(10.0, 170.0, 15.0, -170.0), (85.0, 10.0, 85.0, -160.0), (0.0, 0.0, 0.0, 0.0), (None, 1.0, 2.0, 3.0)]
    roads += [(48 + rng.random() / 50, 2 + rng.random() / 50, 48 + rng.random() / 50, 2 + rng.random() / 50) for _ in range(150)]
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(25)] + [(90.0, 0.0), (12.0, 180.0), (48.01, 2.01), (48.3, 2.3), (0.0, 0.001)]
    df = spark.createDataFrame([*spots, (None, 1.0), (95.0, 0.0)], "latitude double, longitude double")
    named = "lat1 double, lon1 double, lat2 double, lon2 double"
    got = {(r.latitude, r.longitude): r.distance_km for r in places.nearest_road_distance(df, spark.createDataFrame(roads, named)).collect()}
    whole = [r for r in roads if None not in r]
    assert got[(None, 1.0)] is None and got[(95.0, 0.0)] is None and len(got) == 32
    for s in spots:
        assert got[s] == pytest.approx(min(km_to_arc(s, r[:2], r[2:], 400) for r in whole), rel=1e-3, abs=0.3)


def test_cells_divide_where_sites_are_many_and_bounds_hold(spark):
    rng = random.Random(9)
    points = [(rng.gauss(48, 0.02), rng.gauss(2, 0.02)) for _ in range(1500)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    sites = spark.createDataFrame([(*p, 0.0) for p in points], "s_lat double, s_lon double, reach double").distinct()
    cells = places.cells_of(sites)
    assert cells.where("whole and n > 32").where("level < 6").isEmpty() and cells.where("level = 0").agg({"n": "sum"}).first()[0] == 1800
    spot = spark.createDataFrame([(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)], "latitude double, longitude double")
    size = 45.0 / F.pow(F.lit(4.0), F.col("level"))
    inside = (F.col("s_lat") + 90 >= F.col("y") * size) & (F.col("s_lat") + 90 < (F.col("y") + 1) * size) & (F.col("s_lon") + 180 >= F.col("x") * size) & (F.col("s_lon") + 180 < (F.col("x") + 1) * size)
    met = cells.where("level < 3").join(sites, inside).crossJoin(spot)
    least = places.least_km(*[F.col(c) for c in ("latitude", "longitude", "south", "north", "middle", "half")])
    assert met.where(least > places.distance_km(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon"))).isEmpty()
