"""Near-duplicates by the similarity of word shingles, checked exactly.

Two texts are near-duplicates if the sets of their five-word shingles have a
Jaccard similarity of at least 0.8.  The SimHash fingerprints of the sets are
linked first, by the pigeonring chains and the smallest-label components of
``simhash``, with its radius of two bits; every link is confirmed by the
similarity of the whole sets.  At 0.8 two fingerprints differ in about ten bits,
and a radius that finds all such pairs admits nearly every pair, so what the
radius leaves apart is searched further, between the components only: candidates
share one of 40 band keys, each made of six MinHash values: a pair at exactly 0.8
is missed with probability (1 - 0.8^6)^40 = 5e-6, a pair above with less.  Every
candidate is settled by the similarity of the whole sets before it becomes a link.

Members of a bucket with several components first meet its most popular member only, the one whose
buckets are largest: in a group of edited copies that is the text closest to
all, so a group takes rows in proportion to its size.  What is left in buckets
of several components is settled by an exact prefix join: shingles that only
one component has come first, then the rarer ones, and two texts can only reach
0.8 if they share one of their first few with little unshared before it.  A
text with many edits of its own thus meets nobody, however large its bucket is,
and no candidate is left out by a cap.

Defined results: case and kinds of white space do not count; a text of fewer
than five words is one shingle; texts that are null or without words are equal;
repeated rows and equal sets are compared once; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.llm import simhash
from rallylens.llm.tables import text_key
from rallylens.storage import landed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 40, 6
# Bits in which fingerprints may differ to be linked by chains; none has more than 2,080 others so near.
RADIUS = 2


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = min(shingle, len(words))
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops[size - 1 :].tolist())], dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets; 1 for two empty sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


@lru_cache(maxsize=1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def band_keys(values: np.ndarray) -> list[int]:
    """One key for each band; equal keys make two sets candidates."""
    times, plus = _mixers()
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 256):
        np.minimum(least, (values[at : at + 256] * times + plus).min(axis=1), out=least)
    made = [xxhash.xxh64_intdigest(least[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(made, dtype=np.uint64).view(np.int64).tolist()


def set_fingerprint(values: np.ndarray) -> int:
    """SimHash of a shingle set: the majority of each bit over its values; 0 if there are none."""
    ones = np.zeros(simhash.BITS, dtype=np.int64)
    for at in range(0, len(values), 8192):
        bits = values[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(values)).astype(np.uint8), bitorder="little").view("<i8")[0])


SKETCH = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def sketch(text: Column | str) -> Column:
    """Hash of the whole shingle set, its fingerprint and its band keys."""

    @F.arrow_udf(SKETCH)
    def sketches(column: pa.Array) -> pa.Array:
        ids, prints, keys = [], [], []
        for text in column:
            values = shingle_set(text.as_py())
            ids.append(xxhash.xxh64_intdigest(values.tobytes(), 42))
            prints.append(set_fingerprint(values))
            keys.append(band_keys(values))
        named = pa.array(np.array(ids, dtype=np.uint64).view(np.int64), pa.int64())
        return pa.StructArray.from_arrays([named, pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["set_id", "fp", "keys"])

    return sketches.asNondeterministic()(text)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the shingle sets of two text columns."""

    @F.arrow_udf(T.DoubleType())
    def similarities(left: pa.Array, right: pa.Array) -> pa.Array:
        found, last, of = [], None, np.empty(0, dtype=np.uint64)
        for x, y in zip(left, right):
            x = x.as_py() or ""
            if x != last:  # pairs of one left text often follow each other
                last, of = x, shingle_set(x)
            found.append(jaccard(of, shingle_set(y.as_py())))
        return pa.array(found, pa.float64())

    return similarities.asNondeterministic()(a, b)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar; texts: v and text."""
    right = pairs.join(texts.toDF("b", "text_b"), "b")
    both = right.join(texts.toDF("a", "text_a"), "a")
    return landed(both.where(similarity("text_a", "text_b") >= SIMILARITY).select("a", "b"), "similar")


def placed(posts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``posts`` with the component ``l`` that the links give each v."""
    labels = simhash.components(pairs)
    return posts.join(labels, "v", "left").withColumn("l", F.coalesce("l", "v"))


def several(posts: DataFrame, by: str, of: str) -> DataFrame:
    """``by`` and ``df`` (rows), for the values that have several of ``of``."""
    return posts.groupBy(by).agg(F.min(of).alias("least"), F.max(of).alias("most"), F.count("*").alias("df")).where("least < most").select(by, "df")


def ring_pairs(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of sets (v, fp) that the chains link: a fingerprint's sets and its smallest, and the smallest ones of linked fingerprints."""
    first = landed(sets.groupBy("fp").agg(F.min("v").alias("a")), "prints")
    same = sets.join(first, "fp").where("v != a").select("a", F.col("v").alias("b"))
    near = simhash.links(first.select("fp"), radius).toDF("p", "q")
    met = near.join(first.toDF("p", "a"), "p").join(first.toDF("q", "b"), "q").select("a", "b")
    return same.union(met)


def stars(posts: DataFrame) -> DataFrame:
    """Pairs of each bucket's most popular member and its other members; posts: v, key, df."""
    popular = posts.groupBy("v").agg(F.sum("df").alias("score"))
    centres = posts.join(popular, "v").groupBy("key").agg(F.max(F.struct("score", "v"))["v"].alias("a"))
    return posts.join(centres, "key").where("v != a").select("a", F.col("v").alias("b")).distinct()


def at_least(parts: Column, times: int, over: int) -> Column:
    """``parts * times / over``, rounded up."""
    return F.floor((parts * times + over - 1) / over)


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be similar; sets: v, l, shingles.

    A shared shingle at places p and q leaves at most 1 + min(|a| - p, |b| - q)
    shared ones from the first of them on.  The longer text is met with its
    first fifth, the shorter with its first ninth: more cannot come before.
    """
    each = sets.select("v", "l", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("t"))
    told = each.join(several(each, "t", "l"), "t")
    whole = W.partitionBy("v")
    place = F.col("size") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("df", "t"))
    posts = told.withColumn("p", place).where(F.col("p") <= F.col("size") - at_least(F.col("size"), 4, 5) + 1)
    posts = landed(posts.select("v", "l", "size", "t", "p"), "prefixes")
    short = posts.where(F.col("p") <= F.col("size") - at_least(F.col("size"), 8, 9) + 1).toDF("b", "m", "size_b", "t", "q")
    reach = 1 + F.least(F.col("size") - F.col("p"), F.col("size_b") - F.col("q"))
    longer = (F.col("size") > F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("v") > F.col("b")))
    near = longer & (F.col("l") != F.col("m")) & (F.col("size_b") * 5 >= F.col("size") * 4) & (reach >= at_least(F.col("size") + F.col("size_b"), 4, 9))
    met = posts.join(short.withColumnRenamed("t", "u"), (F.col("t") == F.col("u")) & near)
    return met.select(F.col("v").alias("a"), "b").distinct()


def shingles(text: Column | str) -> Column:
    """The shingle set of a text column as an array of hashes."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(column: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py()).view(np.int64) for t in column], pa.list_(pa.int64()))

    return sets.asNondeterministic()(text)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and label, one row per document, landed.

    Texts with the same label are linked by near-duplicates.
    """
    told = docs.select("doc_id", text_key().alias("text_key"), sketch("text").alias("s"))
    rows = landed(told.select("doc_id", "text_key", F.col("s.set_id").alias("v"), F.col("s.fp").alias("fp"), F.col("s.keys").alias("keys")), "sketches")
    example = F.min(F.struct("doc_id", "text_key"))
    firsts = landed(rows.groupBy("v").agg(example.alias("e"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "sets")
    ring = landed(ring_pairs(firsts.select("v", "fp")), "ring")
    posts = firsts.select("v", F.explode("keys").alias("key"))
    posts = landed(posts.join(several(posts, "key", "v"), "key"), "buckets")

    members = posts.select("v").union(ring.select("a")).union(ring.select("b")).distinct()
    wanted = members.join(firsts, "v").select("v", F.col("e.doc_id").alias("id"), F.col("e.text_key").alias("k"))
    source = docs.select("doc_id", text_key().alias("text_key"), "text")
    found = source.join(wanted, source["doc_id"].eqNullSafe(wanted["id"]) & (source["text_key"] == wanted["k"]))
    texts = landed(found.select("v", "text").dropDuplicates(["v"]), "texts")

    ringed = confirmed(ring, texts)
    apart = landed(placed(posts, ringed), "apart")
    apart = landed(apart.join(several(apart, "key", "l").select("key"), "key").select("key", "v", "df"), "buckets")
    near = ringed.union(confirmed(landed(stars(apart), "stars"), texts))
    mixed = landed(placed(apart.select("key", "v"), near), "placed")
    open_ = mixed.join(several(mixed, "key", "l").select("key"), "key").select("v", "l").distinct()
    sets = landed(open_.join(texts, "v").select("v", "l", shingles("text").alias("shingles")), "open")
    near = near.union(confirmed(landed(prefix_pairs(sets), "candidates"), texts))
    named = placed(firsts.select("v"), near)
    return landed(rows.join(named, "v").select("doc_id", "text_key", F.col("l").alias("label")), "grouped")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each label: the smallest id, then the smallest text hash."""
    return simhash.survivors(docs, grouped(docs), F.col("label"))
