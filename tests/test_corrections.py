import math
import random

import numpy as np
import pytest

from rallylens.learn import response
from rallylens.operators import corrections

EVENTS = "k int, label string, truth string"
VERSIONS = "k int, round int, corrected string"


def test_versions_and_accuracy(spark):
    rows = [(1, "a", "b"), (2, "a", "a"), (3, None, "c"), (4, "a", None), (5, "a", "b")]
    versions = [(1, 1, "c"), (1, 3, "b"), (2, 2, "b"), (3, 2, "c"), (3, 2, "b"), (9, 1, "a"), (2, None, "a"), (5, 1, None), (None, 1, "z")]
    events, told = spark.createDataFrame(rows, EVENTS), spark.createDataFrame(versions, VERSIONS)

    def after(r):
        return {x.k: x.label for x in corrections.labels_as_of(events, told, "k", "label", r).collect()}

    assert after(0) == {1: "a", 2: "a", 3: None, 4: "a", 5: "a"}
    assert after(2) == {1: "c", 2: "b", 3: "c", 4: "a", 5: "a"} and after(None)[1] == "b"
    got = {r["round"]: (r["n"], r["right"], r["accuracy"]) for r in corrections.accuracy_by_round(events, told, "k", "label", "truth").collect()}
    truth = {k: t for k, _, t in rows if t}
    want = {r: sum(after(r)[k] == t for k, t in truth.items()) for r in (0, 1, 2, 3)}
    assert got == {r: (4, n, n / 4) for r, n in want.items()}
    assert [tuple(r) for r in corrections.accuracy_by_round(events, told.limit(0), "k", "label", "truth").collect()] == [(0, 4, 1, 0.25)]


def test_error_terms_and_next_rows(spark):
    wrong = spark.createDataFrame([(i, i < 10) for i in range(100)], "k int, wrong boolean")
    words = [(i, "odd") for i in range(8)] + [(i, "all") for i in range(100)] * 2 + [(99, "rare")]
    got = corrections.error_terms(spark.createDataFrame(words, "k int, word string"), wrong, "k").collect()
    assert [(r.word, r.n_wrong, r.n_right) for r in got] == [("odd", 8, 0), ("all", 10, 90)]
    assert got[0].log_odds == pytest.approx(math.log(8.5 / 0.5) - math.log(2.5 / 90.5), abs=1e-6)
    rows = [(1, "s", 0.5), (2, "s", 0.4), (3, "s", 0.6), (4, "s", 0.9), (5, "t", 0.1), (6, "t", None), (7, None, 0.3)]
    picked = corrections.next_to_code(spark.createDataFrame(rows, "k int, g string, p double"), spark.createDataFrame([(1,)], "k int"), "k", ["g"], "p", 2)
    assert sorted((r.k, r.place, r.doubt) for r in picked.collect()) == [(2, 1, 0.8), (3, 2, 0.8), (5, 1, 0.2), (7, 1, 0.6)]


def test_morans_i_and_lag_against_dense_matrices(spark):
    rng = random.Random(4)
    places = rng.sample([(y, x) for y in range(-4, 5) for x in range(-4, 5)], 45) + [(40, 40)]
    rate = {p: rng.random() + 0.2 * p[0] for p in places}
    cells = spark.createDataFrame([(*p, r) for p, r in rate.items()], "cell_lat int, cell_lon int, rate double")
    w = np.array([[float(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1) for b in places] for a in places])
    x = np.array([rate[p] for p in places])
    z, n, total = x - x.mean(), len(x), w.sum()
    index, expected = n / total * (z @ w @ z) / (z @ z), -1 / (n - 1)
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    spread = (n * n * s1 - n * s2 + 3 * total**2) / (total**2 * (n * n - 1)) - expected**2
    got = response.morans_i(cells).first()
    assert (got.cells, got.pairs) == (n, total) and got.expected == pytest.approx(expected)
    assert got.morans_i == pytest.approx(index) and got.z_score == pytest.approx((index - expected) / math.sqrt(spread))
    lag = {(r.cell_lat, r.cell_lon): (r.neighbours, r.lag) for r in response.spatial_lag(cells).collect()}
    for i, p in enumerate(places):
        k = int(w[i].sum())
        assert lag[p][0] == k and (lag[p][1] is None if not k else lag[p][1] == pytest.approx(w[i] @ x / k))
    assert response.morans_i(cells.limit(1)).first().morans_i is None
    assert response.morans_i(cells.limit(0)).first().cells == 0
