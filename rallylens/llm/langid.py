"""Language identification with string kernels.

A text is the set of character n-grams it holds (blended spectrum: orders 1 to
3, lower-cased, hashed to a fixed number of slots).  The kernel of two texts is
the number of shared n-grams over the geometric mean of their set sizes.  A
bounded sample of labelled texts gives the landmarks of a Nystroem map; ridge
regression on that map, one against the rest, gives the weights.  Scoring is
two matrix products per batch.

Defined results: a text that is null or has no letter is ``und`` with score 0;
with nothing to learn from every text is ``und``.  Texts are used whole and
repeated rows are each answered.  Columns of the documents besides the text are
never inputs; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.llm.tables import bounded_ids, texts_of

UNKNOWN = "und"
SLOTS = 1 << 17
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
ARROW_RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass
class KernelModel:
    langs: list[str]
    slots: np.ndarray  # n-gram slots some landmark holds
    landmarks: np.ndarray  # slots x landmarks, each column divided by its norm
    weights: np.ndarray  # landmarks x languages


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_slots(text: str) -> np.ndarray:
    """Slot of every 1-, 2- and 3-gram of the whole text, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    one = c * np.uint32(0x9E3779B1)
    parts = [one]
    if len(c) > 1:
        two = one[:-1] * np.uint32(0x85EBCA77) + one[1:] + np.uint32(1)
        parts.append(two)
    if len(c) > 2:
        parts.append(two[:-1] * np.uint32(0xC2B2AE3D) + one[2:] + np.uint32(2))
    h = np.concatenate(parts)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 17)


def presence(texts: list[str], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows over ``slots`` and the number of distinct n-grams of each text."""
    rows = np.zeros((len(texts), len(slots)), dtype=np.float32)
    sizes = np.ones(len(texts))
    seen = np.zeros(SLOTS, dtype=bool)
    for i, text in enumerate(texts):
        found = ngram_slots(text)
        seen[found] = True
        sizes[i] = max(1, np.count_nonzero(seen))
        rows[i] = seen[slots]
        seen[found] = False
    return rows, sizes


def fit(
    docs: DataFrame, labelled: DataFrame, per_lang: int = 200, landmarks: int = 40, ridge: float = 0.03, most: int = 3_200
) -> KernelModel:
    """Fit on at most ``per_lang`` texts of each language and about ``most`` in all.

    ``labelled``: doc_id and lang of the rows to learn from.  Only the sets of
    n-grams (16 kB a text) reach the driver; with many languages each has fewer
    texts and landmarks.
    """
    named = labelled.where(F.col("lang").isNotNull()).agg(F.count_distinct("lang")).first()[0]
    sample = texts_of(docs, bounded_ids(labelled, "lang", min(per_lang, max(1, most // max(1, named)))))

    @F.arrow_udf(T.BinaryType())
    def made(column: pa.Array) -> pa.Array:
        sets = (np.bincount(ngram_slots(t), minlength=SLOTS) > 0 for t in column.to_pylist())
        return pa.array([np.packbits(s).tobytes() for s in sets], pa.binary())

    usable = sample.where(F.col("text").rlike(r"\p{L}"))
    rows = usable.select("doc_id", "lang", made.asNondeterministic()("text").alias("bits")).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id))
    langs = sorted({r.lang for r in rows})
    if not langs:
        return KernelModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    of = np.array([langs.index(r.lang) for r in rows])
    each = min(landmarks, max(1, 512 // len(langs)))
    chosen = np.concatenate([np.flatnonzero(of == k)[:each] for k in range(len(langs))])

    def held(i: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(rows[i].bits, np.uint8))

    slots = np.flatnonzero(np.any([held(i) for i in chosen], axis=0))
    x = np.zeros((len(rows), len(slots)), dtype=np.float32)
    for i in range(len(rows)):
        bits = held(i)
        x[i] = bits[slots] / np.sqrt(max(1, int(bits.sum(dtype=np.int64))))
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ marks.T).astype(np.float64) @ whiten
    target = np.where(of[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    share = 1.0 / np.bincount(of, minlength=len(langs))[of]  # languages weigh the same
    left = (phi * share[:, None]).T @ phi + ridge * np.eye(phi.shape[1]) * share.sum() / len(of)
    solved = np.linalg.solve(left, (phi * share[:, None]).T @ target)
    return KernelModel(langs, slots, np.ascontiguousarray(marks.T), (whiten @ solved).astype(np.float32))


def score_texts(texts: list[str | None], model: KernelModel, block: int = 128) -> tuple[list[str], list[float]]:
    """Language and score of each text, in blocks of matrix products."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    usable = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
    for at in range(0, len(usable), block):
        part = usable[at : at + block]
        rows, sizes = presence([texts[i] for i in part], model.slots)
        kernel = (rows @ model.landmarks) / np.sqrt(sizes)[:, None].astype(np.float32)
        raw = (kernel @ model.weights).astype(np.float64)
        odds = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
        odds /= odds.sum(axis=1, keepdims=True)
        for i, k, s in zip(part, raw.argmax(axis=1), odds.max(axis=1)):
            langs[i], scores[i] = model.langs[k], float(s)
    return langs, scores


def language(text: Column | str, model: KernelModel) -> Column:
    """Struct of lang_pred and score for a text column."""

    @F.arrow_udf(RESULT)
    def identify(column: pa.Array) -> pa.Array:
        langs, scores = score_texts(column.to_pylist(), model)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(ARROW_RESULT))

    return identify.asNondeterministic()(text)
