"""SimHash near-duplicates, with candidates from pigeonring filtering.

A fingerprint's 64 bits lie on a ring of ``radius + 1`` segments.  If two
fingerprints differ in at most ``radius`` bits, some segment starts a chain
whose first k segments differ in at most floor(k * radius / segments) bits
together, for every k: none in the first, at most one in the first two, and so
on.  The first two links of the chain are an equi-join key (one side also
probes its zero bits, so each single difference is found from one side), the
longer prefixes and the full distance are conditions of the same join, so rows
that fail never leave it.  Components come from rounds of smallest-label
passing with shortcuts, each round landed in the shared folder.

Defined results: a text that is null or without words has fingerprint zero and
links like any other; repeated rows and equal texts share a fingerprint, which
is compared once; a null id never names a component unless all its ids are
null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.llm.tables import text_key, unused
from rallylens.storage import landed

BITS = 64


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of XXH64 over the word shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])[: len(words) - size + 1].tolist()
    stops = stops[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), 8192):
        part = [digest(joined[s:e], 42) for s, e in zip(starts[at : at + 8192], stops[at : at + 8192])]
        bits = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    high = (ones * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(high, bitorder="little").view("<i8")[0])


def fingerprint(text: Column | str, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf(T.LongType())
    def fingerprints(column: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(t, shingle) for t in column.to_pylist()], pa.int64())

    return fingerprints.asNondeterministic()(text)


def segment_widths(segments: int) -> list[int]:
    return [BITS * (i + 1) // segments - BITS * i // segments for i in range(segments)]


def links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column fp) at most ``radius`` bits apart.

    Distinct fingerprints differ, so a radius of 0 has no pairs.
    """
    if radius < 1:
        return fingerprints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    n = radius + 1
    widths = segment_widths(n)
    low = [sum(widths[:i]) for i in range(n)]

    def segment(fp: Column, i: int) -> Column:
        return F.shiftrightunsigned(fp, low[i % n]).bitwiseAND(F.lit((1 << widths[i % n]) - 1))

    def key(fp: Column, i: int) -> Column:
        """Chain number, first and second segment."""
        first = F.shiftleft(segment(fp, i), widths[(i + 1) % n])
        return F.struct(F.lit(i).alias("chain"), first.bitwiseOR(segment(fp, i + 1)).alias("head"))

    def probes(fp: Column, i: int) -> Column:
        """The key itself and, where one difference is allowed, each of its zero bits set."""
        own = key(fp, i)
        flips = F.array(*[F.lit(1 << b).cast("long") for b in range(widths[(i + 1) % n])])
        free = F.filter(flips, lambda x: own["head"].bitwiseAND(x) == 0)
        return F.concat(F.array(own), F.transform(free, lambda x: F.struct(own["chain"].alias("chain"), own["head"].bitwiseOR(x).alias("head"))))

    fp = F.col("fp")
    posted = fingerprints.select(fp.alias("q"), F.explode(F.array(*[key(fp, i) for i in range(n)])).alias("k"))
    probing = fingerprints.select(fp.alias("p"), F.explode(F.concat(*[probes(fp, i) for i in range(n)])).alias("k"))
    differ = F.col("p").bitwiseXOR(F.col("q"))
    within = F.lit(True)
    for i in range(n):
        total = F.lit(0)
        for k in range(n):
            total = total + F.bit_count(segment(differ, i + k))
            if k >= 1:  # prefixes beyond the first segment
                within = within & ((F.col("chain") != i) | (total <= (k + 1) * radius // n))
    posted = posted.select("q", "k.chain", "k.head")
    probing = probing.select("p", F.col("k.chain").alias("chain"), F.col("k.head").alias("head"))
    near = (F.col("p") != F.col("q")) & within & (F.bit_count(differ) <= radius)
    found = probing.join(posted, ["chain", "head"]).where(near)
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """v and its component's smallest member, for every v of the pairs (a, b)."""
    edges = landed(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("u", "v"), "edges")
    labels = landed(edges.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("v"), F.least("u", "l").alias("l")), "labels")
    before = None
    while True:
        state = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return labels
        before = state
        heard = edges.join(labels, "v").select(F.col("u").alias("v"), "l").union(labels.select("v", "l"))
        lower = landed(heard.groupBy("v").agg(F.min("l").alias("l")), "labels")
        above = lower.select(F.col("v").alias("l"), F.col("l").alias("top"))
        labels = landed(lower.join(above, "l", "left").select("v", F.coalesce("top", "l").alias("l")), "labels")


def grouped(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fp and component_id, one row per document, landed.

    Every text is read once; all later steps move ids and fingerprints only.
    """
    rows = landed(docs.select("doc_id", text_key().alias("text_key"), fingerprint("text", shingle).alias("fp")), "fingerprints")
    firsts = landed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "firsts")
    labels = components(links(firsts.select("fp"), radius))
    placed = firsts.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("l", F.coalesce("l", "fp"))
    heads = placed.groupBy("l").agg(F.min("first_id").alias("component_id"))
    named = placed.join(heads, "l").select("fp", "component_id")
    return landed(rows.join(named, "fp").select("doc_id", "text_key", "fp", "component_id"), "grouped")


def fingerprint_text(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp) if isinstance(fp, str) else fp), BITS // 4, "0"))


def drop_near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each component: the smallest id, then the smallest text hash."""
    return survivors(docs, grouped(docs, radius, shingle), F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp"))))


def survivors(docs: DataFrame, rows: DataFrame, anchor: Column) -> DataFrame:
    """One document of each ``anchor`` of rows (doc_id, text_key and its columns).

    Rows that agree in id and text are one document; the first of them stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_key").alias("k"))
    copies = rows.groupBy(anchor.alias("c"), "doc_id", "text_key").agg(F.count("*").alias("copies"))
    best = copies.groupBy("c").agg(F.min_by(F.struct("doc_id", "text_key", "copies"), order).alias("b"))
    key, of, n = (unused(docs, c) for c in ("text_key", "kept_id", "kept_copies"))
    kept = landed(best.select(F.col("b.doc_id").alias(of), F.col("b.text_key").alias("kept_key"), F.col("b.copies").alias(n)), "kept")
    marked = docs.withColumn(key, text_key())
    chosen = marked.join(kept, marked["doc_id"].eqNullSafe(kept[of]) & (marked[key] == kept["kept_key"]))
    single = chosen.where(F.col(n) == 1).select(*docs.columns)
    if kept.where(F.col(n) > 1).isEmpty():
        return single
    return single.union(chosen.where(F.col(n) > 1).dropDuplicates(["doc_id", key]).select(*docs.columns))
