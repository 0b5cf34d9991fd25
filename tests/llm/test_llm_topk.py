import math

import numpy as np
import pytest

from rallylens.llm import topk


def brute(rows, queries, k):
    out = []
    for q_id, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != q_id)[:k]
        out += [(q_id, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block,pivots", [(8192, 64), (40, 3)])
def test_exact_with_ties_clusters_and_copies(spark, block, pivots):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, 400)] + 0.2 * rng.normal(size=(400, 8))).round(2)
    x[100:220] = x[100]
    data = [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]
    odd = [(1000, None, 0), (1050, [1.0, None], 0), (1100, [math.nan] * 8, 0), (1150, [math.inf] * 8, 0), (None, [1.0] * 8, 0), (1200, [], 0), (1250, [0.5, 2.0], 0), (7, data[8][1], 0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, rank int")
    rows = topk.quantised(df)
    got = topk.search(rows, rows.where("vec_id % 50 = 0"), 5, pivots, 64, block).collect()
    exact = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in data + odd if i in (1200, 1250) or (v and len(v) == 8 and i is not None and math.isfinite(v[0]))]
    assert sorted(map(tuple, got)) == brute(exact, [r for r in exact if r[0] % 50 == 0], 5)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5]), (51, [0.0, -1.0])], "vec_id long, embedding array<double>")
    rows = topk.quantised(df)
    got = topk.search(rows, rows.where("vec_id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 50, 32768), (0, 2, 51, 0), (50, 1, 0, 32768), (50, 2, 51, -32768)]
    assert topk.search(rows.limit(0), rows.limit(0)).collect() == []


def test_a_node_covers_its_rows():
    x = np.random.default_rng(0).normal(size=(700, 5))
    todo, leaves = [topk.cover_tree(x)], 0
    while todo:
        node = todo.pop()
        assert np.linalg.norm(x[node.rows] - node.centre, axis=1).max() <= node.radius + 1e-9
        assert not node.children or sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        leaves += 0 if node.children else len(node.rows)
        todo += node.children
    assert leaves == 700


def test_one_id_and_one_row_repeated_very_often(spark):
    """Copies beyond k change nothing, and rows of one id spread over the blocks."""
    rng = np.random.default_rng(5)
    rows = [(7, [1.0, 0.5])] * 3000 + [(9, [float(v) for v in rng.normal(size=2).round(2)]) for _ in range(500)] + [(i, [0.1 * i, 1.0]) for i in (0, 50, 51)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.search(df, df.where("vec_id % 50 = 0"), 5, 3, 64, 40).collect()
    exact = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    assert sorted(map(tuple, got)) == brute(exact, [r for r in exact if r[0] % 50 == 0], 5)
