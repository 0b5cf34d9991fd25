"""Quality classifier: a generalised additive model with pairwise interactions.

Dense features of a whole text (sizes, character classes, repetition, layout)
are cut into quantile bins.  Cyclic boosting goes round the features with a low
learning rate; each visit fits a shallow tree to the gradient over one
feature's bins and adds it to that feature's table.  Then the pairs with the
largest gain on the residual get two-dimensional tables the same way.  A score
is the logistic of an intercept and one table entry per feature and pair: all
additions are looked up for whole batches.

The model is fitted on a bounded sample of labelled rows (``per_label`` of each
label, weighted back to the label shares of all rows) on the driver; only
features are collected.

Defined results: a null text is empty; an empty text gets features of zero and a
score like any other; with nothing to learn every score is 0.5; repeated rows
are each answered; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.llm.tables import bounded_ids, texts_of
from rallylens.llm.trees import best_cut, binned, gain, grow_steps, logit, quantile_edges, sigmoid

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "space", "newline", "wide", "comma_stop", "shout", "symbol", "bar", "bracket",
    "distinct_words", "repeated_next", "distinct_lines", "line_words", "capital_words", "odd_ends", "packed",
]
CLASSES = [
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (b"abcdefghijklmnopqrstuvwxyz"), b"0123456789", b" \t", b"\n", bytes(range(128, 256)), b",.", b"!?", b"#$%&*@^~=+_\\/<>", b"|", b"()[]{}",
]
CLASS_OF = np.full(256, len(CLASSES), dtype=np.int64)
for _k, _members in enumerate(CLASSES):
    CLASS_OF[list(_members)] = _k
IS_END = np.zeros(256, dtype=bool)
IS_END[list(b"!#$%&*|@^~=+_")] = True


def text_features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(raw, dtype=np.uint8)
    shares = np.bincount(CLASS_OF[codes], minlength=len(CLASSES) + 1)[: len(CLASSES)] / n
    words = raw.split()
    lines = raw.split(b"\n")
    nw = max(1, len(words))
    blank = codes <= 32
    starts = codes[1:][blank[:-1] & ~blank[1:]]
    ends = codes[:-1][blank[1:] & ~blank[:-1]]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), n / nw, *shares.tolist(),
        len(set(words)) / nw, sum(map(eq, words, words[1:])) / nw, len(set(lines)) / len(lines), nw / len(lines),
        float(((starts >= 65) & (starts <= 90)).sum()) / nw, float(IS_END[ends].sum()) / nw, len(zlib.compress(raw, 1)) / n,
    ]


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin to pair bin, per feature

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if not self.tables or not len(x):
            return z
        b = binned(x, self.edges)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for i, j, table in self.pairs:
            z += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def grid_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts one axis, then each half along the other."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gt, ht = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gt.shape[0]):
            won, made = -gain(gt.sum(), ht.sum(), ridge), np.zeros_like(gt)
            for rows in (slice(0, cut), slice(cut, None)):
                gs, hs = gt[rows].sum(axis=0), ht[rows].sum(axis=0)
                at = best_cut(gs, hs, ridge, least)[1]
                for cols in (slice(0, at), slice(at, None)):
                    sg, sh = gs[cols].sum(), hs[cols].sum()
                    won += gain(sg, sh, ridge)
                    made[rows, cols] = sg / (sh + ridge)
            if won > best:
                best, values = float(won), made.T if turned else made
    return best, values


def fit_additive(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.1, leaves: int = 4, n_pairs: int = 6, ridge: float = 1.0, least: float = 5.0
) -> AdditiveModel:
    """Cyclic boosting of one-feature trees, then of two-feature trees."""
    if not len(y) or y.min() == y.max():
        return AdditiveModel(0.0 if not len(y) else logit(float(y.mean())))
    model = AdditiveModel(logit(float((y * weight).sum() / weight.sum())), quantile_edges(x))
    b = binned(x, model.edges)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    model.coarse = [np.arange(s) * 8 // max(s, 8) for s in sizes]
    z = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(z)
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for j, s in enumerate(sizes):
            g, h = slopes()
            step = rate * grow_steps(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), leaves, ridge, least)
            model.tables[j] += step
            z += step[b[:, j]]
    c = [model.coarse[j][b[:, j]] for j in range(len(sizes))]

    def grid(values: np.ndarray, i: int, j: int) -> np.ndarray:
        return np.bincount(c[i] * 8 + c[j], values, 64).reshape(8, 8)

    g, h = slopes()
    gains = [(grid_tree(grid(g, i, j), grid(h, i, j), ridge, least)[0], i, j) for i in range(len(sizes)) for j in range(i)]
    chosen = [(i, j) for won, i, j in sorted(gains, reverse=True)[:n_pairs] if won > 1.0]
    found = {pair: np.zeros((8, 8)) for pair in chosen}
    for _ in range(rounds // 4):
        for i, j in chosen:
            g, h = slopes()
            step = rate * grid_tree(grid(g, i, j), grid(h, i, j), ridge, least)[1]
            found[i, j] += step
            z += step[c[i], c[j]]
    model.pairs = [(i, j, table) for (i, j), table in found.items()]
    return model


def sample_features(docs: DataFrame, labelled: DataFrame, label: str, per_label: int, features: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, labels and weights of a bounded sample.

    ``labelled``: doc_id and a 0/1 label.  Weights restore the label shares of
    all labelled rows, which are counted exactly.
    """
    shares = {r[0]: r[1] for r in labelled.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    rows = texts_of(docs, bounded_ids(labelled, label, per_label)).select("doc_id", label, features.alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([float(r[label]) for r in rows])
    drawn = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    whole = max(1, sum(shares.values()))
    weight = np.array([shares.get(int(v), 0) / drawn[int(v)] * len(y) / whole for v in y])
    x = np.array([r.x for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    return x, y, weight


def features(text: str = "text") -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def made(column: pa.Array) -> pa.Array:
        return pa.array([text_features(t) for t in column.to_pylist()], pa.list_(pa.float64()))

    return made.asNondeterministic()(text)


def fit(docs: DataFrame, labelled: DataFrame, label: str = "quality", per_label: int = 6000) -> AdditiveModel:
    return fit_additive(*sample_features(docs, labelled, label, per_label, features()))


def quality(text: Column | str, model: AdditiveModel) -> Column:
    """Score from 0 to 1 of a text column."""

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        x = np.array([text_features(t) for t in column.to_pylist()]).reshape(len(column), -1)
        return pa.array(model.scores(x), pa.float64())

    return scored.asNondeterministic()(text)
