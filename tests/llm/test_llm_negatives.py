import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallylens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, code string, block int, best string"


def brute(rows, k=5):
    """All pairs; rows are (id, label, whole-number vector)."""
    out = []
    for a_id, a_label, a in {(i, c, tuple(v)) for i, c, v in rows if i % 100 == 0}:
        scored = [(-sum(x * y for x, y in zip(a, v)), i, c) for i, c, v in rows]
        for ps, p, _ in sorted(s for s in scored if s[2] == a_label and s[1] != a_id)[:k]:
            inside = sorted(s for s in scored if s[2] != a_label and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:k]
            out += [(a_id, p, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **kind):
    df = spark.createDataFrame([(i, v, c, "x", 1, "y") for i, c, v in rows], SCHEMA)
    return sorted(map(tuple, negatives.mine(negatives.labelled(df, F.col("label")), F.col("vec_id") % 100 == 0, **kind).collect()))


def whole(rows):
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    return [(i, c, [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v in good]


@pytest.mark.parametrize("block", [8192, 60])
def test_exact_with_clusters_copies_ties_and_odd_rows(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 12))
    x = (centres[rng.integers(0, 5, 500)] + 0.3 * rng.normal(size=(500, 12))).round(1)
    rows = [(i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(200, 2, rows[3][2])] * 40 + [(7, 1, rows[200][2])] * 9 + [(901, 0, rows[100][2])] * 7  # copies, other labels of an id
    rows += [(600, None, rows[0][2]), (700, 1, None), (800, 1, [math.nan] * 12), (None, 1, rows[0][2]), (1000, 0, []), (1100, 1, [0.5]), (1101, 1, [math.inf]), (1102, 0, [None])]
    assert mined(spark, rows, block=block) == brute(whole(rows))


def test_few_rows_and_none(spark):
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [-1.0])]) == [(0, 1, 1, 2, 65536, 58880)]
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == []


def given(sf):
    import pyarrow.parquet as pq

    return np.floor(256 * np.array(pq.read_table(f"{sf}/embeddings.parquet")["embedding"].to_pylist()))


def test_intervals_hold_every_score_and_rule_rows_out(sf):
    """Certain on the given vectors and on clusters; prints what part of the rows must be scored."""
    rng = np.random.default_rng(0)
    clustered = np.floor(256 * (rng.normal(size=(20, 64))[rng.integers(0, 20, 500)] + 0.2 * rng.normal(size=(500, 64))))
    for name, x in (("given", given(sf)), ("clustered", clustered), ("zeros", np.zeros((4, 3))), ("one", np.array([[1.0], [-2.0]]))):
        turn = negatives.rotations(x.shape[1])
        assert np.allclose(turn.T @ turn, np.eye(x.shape[1]))
        code, along, across, length = negatives.codes(x, turn)
        block = object.__new__(negatives.Block)
        block.code, block.along, block.across, block.length = code, along, across, length
        block.ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        left = []
        for q in x[::25]:
            estimate, low, high = negatives.Query(q, turn).interval(block, slice(None))
            exact = x @ q
            assert (low <= exact).all() and (exact <= high).all()
            left.append((high >= np.sort(exact)[-min(6, len(exact))]).mean())
        print(f"{name}: {np.mean(left):.3f} of the rows reach the sixth best score")
        assert name != "clustered" or np.mean(left) < 0.2
