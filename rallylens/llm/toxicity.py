"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a whole text: densities of a lexicon, of its disguised spellings
and of hits near a second-person word; shares of capitals, shouting marks and
digits; letter repeats.  The lexicon is a short list of insults and what the
labelled rows themselves show: words and word beginnings found in toxic texts
and hardly elsewhere.  Trees are grown on quantile bins; scores of rows the
trees have not seen are calibrated by pooling adjacent violators.

Fitted on a bounded sample of labelled rows (``per_label`` of each label,
weighted back to the label shares of all rows); the driver gets the features
and at most ``terms`` lexicon entries.

Defined results: a null text is empty; an empty text has features of zero and a
score like any other; with nothing to learn the score is 0.5; repeated rows are
each answered; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.llm.quality import sample_features
from rallylens.llm.tables import bounded_ids, texts_of
from rallylens.llm.trees import binned, gain, isotonic, logit, quantile_edges, sigmoid

# Common insults, and words that address the reader.
INSULTS = "idiot moron stupid pathetic disgusting worthless trash scum loser clown dumb imbecile".split()
ADDRESS = "you your yours u ur du dich dir dein euch tu te ti tus vous vos ton toi usted ustedes".split()
ADDRESSES = frozenset(w.encode() for w in ADDRESS)
STEMS = (4, 5, 6)
NEAR = 3
#: Signs that stand for letters, and everything that is no letter as a space.
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
PLAIN = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
DISGUISED = re.compile(rb"[a-z@$]+(?:[*.\-_'!$@0-9]+[a-z]+)+")  # signs or digits inside a word
SPACED = re.compile(rb"(?<![a-z])(?:[a-z][ .\-_*]){3,}[a-z](?![a-z])")  # letters one by one
MASKS = b"*.-_'!$@"
FEATURES = ["log_words", "lexicon", "log_hits", "disguised", "near_address", "address", "capitals", "capital_words", "shout", "digits", "repeats"]


@dataclass
class Lexicon:
    words: frozenset[bytes]
    stems: frozenset[bytes]

    def has(self, word: bytes) -> bool:
        return word in self.words or any(word[:n] in self.stems for n in STEMS)


def collapsed(word: bytes) -> bytes:
    """The word without repeated letters."""
    return bytes(c for i, c in enumerate(word) if not i or word[i - 1] != c)


def text_features(text: str | None, lexicon: Lexicon, squeezed: frozenset[bytes]) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    low = text.lower().encode("utf-8", "replace")
    words = low.translate(PLAIN).split()
    n = max(1, len(words))
    in_words, in_stems = lexicon.words.__contains__, lexicon.stems.__contains__
    hit = list(map(in_words, words))
    for k in STEMS:
        hit = [a or in_stems(w[:k]) for a, w in zip(hit, words)]
    hits = sum(hit)
    addressed = [w in ADDRESSES for w in words]
    near = 0
    if hits:
        near = sum(any(addressed[max(0, i - NEAR) : i + NEAR + 1]) for i, h in enumerate(hit) if h)
    codes = np.frombuffer(low, dtype=np.uint8)
    repeats = int(((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & (codes[2:] >= 97) & (codes[2:] <= 122)).sum())
    opened = [t.translate(LEET).translate(None, MASKS) for t in set(DISGUISED.findall(low))]
    opened += [t.translate(None, b" " + MASKS) for t in set(SPACED.findall(low))]
    disguised = sum(lexicon.has(t) or collapsed(t) in squeezed for t in opened)
    if repeats:
        disguised += sum(collapsed(w) in squeezed for w in set(words) if w not in lexicon.words)
    codes = np.frombuffer(raw, dtype=np.uint8)
    upper = (codes >= 65) & (codes <= 90)
    letters = max(1, int(upper.sum() + ((codes >= 97) & (codes <= 122)).sum()))
    return [
        float(np.log1p(n)), hits / n, float(np.log1p(hits)), float(np.log1p(disguised)), near / n, sum(addressed) / n,
        float(upper.sum()) / letters, float((upper[1:] & upper[:-1]).sum()) / letters,
        float((codes == 33).sum()) / n, float(((codes >= 48) & (codes <= 57)).sum()) / n, repeats / n,
    ]


def learn_lexicon(sample: DataFrame, label: str, terms: int = 300, least: int = 4, odds: float = 3.0) -> Lexicon:
    """Words and word beginnings that toxic texts of the sample hold and others hardly do.

    ``sample``: text and a 0/1 label.  Each term counts once a text.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    said = F.transform(words, lambda w: F.concat(F.lit("0"), w))
    for k in STEMS:
        said = F.concat(said, _beginnings(words, k))
    counted = sample.select(label, F.explode(F.array_distinct(said)).alias("term")).groupBy("term").agg(
        F.count_if(F.col(label) == 1).alias("bad"), F.count_if(F.col(label) == 0).alias("good")
    )
    totals = sample.agg(F.count_if(F.col(label) == 1).alias("b"), F.count_if(F.col(label) == 0).alias("g")).first()
    if not totals.b or not totals.g:
        return Lexicon(frozenset(w.encode() for w in INSULTS), frozenset())
    score = F.log((F.col("bad") + 0.5) / (totals.b + 1)) - F.log((F.col("good") + 0.5) / (totals.g + 1))
    best = counted.where((F.length("term") > 3) & (F.col("bad") >= least) & (score >= odds)).orderBy((F.col("bad") * score).desc(), "term").limit(terms).collect()
    found = [(r.term[0], r.term[1:].encode()) for r in best]
    return Lexicon(frozenset(t for k, t in found if k == "0") | {w.encode() for w in INSULTS}, frozenset(t for k, t in found if k != "0"))


def _beginnings(words: Column, k: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) >= k)
    return F.transform(longer, lambda w: F.concat(F.lit(str(k)), F.substring(w, 1, k)))


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray  # bins below go left
    value: np.ndarray  # of the leaves

    def leaf(self, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), dtype=np.int64)
        rows = np.arange(len(b))
        for _ in range(int(np.log2(len(self.value)))):
            at = 2 * at + 1 + (b[rows, self.feature[at]] >= self.cut[at])
        return at - (len(self.value) - 1)


@dataclass
class BoostedModel:
    lexicon: Lexicon
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        if self.trees and len(x):
            b = binned(x, self.edges)
            for tree in self.trees:
                z += tree.value[tree.leaf(b)]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.margin(x)
        return np.interp(z, self.at, self.value) if len(self.at) else sigmoid(z)


def grow_tree(b: np.ndarray, g: np.ndarray, h: np.ndarray, sizes: list[int], depth: int, ridge: float, least: float, rate: float) -> Tree:
    """A full binary tree of the given depth; a node without a good cut sends all left."""
    nodes = 2**depth - 1
    feature, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, 1 << 30, dtype=np.int64)
    at = np.zeros(len(b), dtype=np.int64)
    for level in range(depth):
        for node in range(2**level - 1, 2 ** (level + 1) - 1):
            mine = at == node
            if not mine.any():
                continue
            best = 1e-6
            for j, size in enumerate(sizes):
                gl = np.cumsum(np.bincount(b[mine, j], g[mine], size))
                hl = np.cumsum(np.bincount(b[mine, j], h[mine], size))
                won = gain(gl, hl, ridge) + gain(gl[-1] - gl, hl[-1] - hl, ridge) - gain(gl[-1], hl[-1], ridge)
                won = np.where((hl >= least) & (hl[-1] - hl >= least), won, 0.0)
                k = int(won.argmax())
                if won[k] > best:
                    best, feature[node], cut[node] = float(won[k]), j, k + 1
        at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] >= cut[at])
    leaf = at - nodes
    value = rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + ridge)
    return Tree(feature, cut, value)


def fit_boosted(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, lexicon: Lexicon, trees: int = 60, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, least: float = 2.0
) -> BoostedModel:
    """Trees on four of five rows, calibration on the fifth."""
    if not len(y) or y.min() == y.max():
        return BoostedModel(lexicon, 0.0 if not len(y) else logit(float(y.mean())))
    apart = np.arange(len(y)) % 5 == 4
    if not 0 < y[apart].mean() < 1 or not 0 < y[~apart].mean() < 1:
        apart = np.zeros(len(y), dtype=bool)
    model = BoostedModel(lexicon, logit(float((y * weight)[~apart].sum() / weight[~apart].sum())), quantile_edges(x))
    b, t, w = binned(x[~apart], model.edges), y[~apart], weight[~apart]
    sizes = [len(e) + 1 for e in model.edges]
    z = np.full(len(t), model.intercept)
    for _ in range(trees):
        p = sigmoid(z)
        tree = grow_tree(b, w * (t - p), w * p * (1 - p), sizes, depth, ridge, least, rate)
        model.trees.append(tree)
        z += tree.value[tree.leaf(b)]
    if apart.any():
        model.at, model.value = isotonic(model.margin(x[apart]), y[apart], weight[apart])
    return model


def fit(docs: DataFrame, labelled: DataFrame, label: str = "toxic", per_label: int = 6000) -> BoostedModel:
    lexicon = learn_lexicon(texts_of(docs, bounded_ids(labelled, label, per_label)), label)
    return fit_boosted(*sample_features(docs, labelled, label, per_label, features(lexicon)), lexicon)


def features(lexicon: Lexicon, text: str = "text") -> Column:
    squeezed = frozenset(map(collapsed, lexicon.words))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def made(column: pa.Array) -> pa.Array:
        return pa.array([text_features(t, lexicon, squeezed) for t in column.to_pylist()], pa.list_(pa.float64()))

    return made.asNondeterministic()(text)


def toxicity(text: Column | str, model: BoostedModel) -> Column:
    """Score from 0 to 1 of a text column."""
    squeezed = frozenset(map(collapsed, model.lexicon.words))

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        x = np.array([text_features(t, model.lexicon, squeezed) for t in column.to_pylist()]).reshape(len(column), -1)
        return pa.array(model.scores(x), pa.float64())

    return scored.asNondeterministic()(text)
