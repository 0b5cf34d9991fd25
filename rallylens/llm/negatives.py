"""Hard negatives by rotated one-bit codes with residual intervals.

Every vector gets the signs of its components under ``SPREAD`` stacked random
rotations, ``SPREAD`` bits for each dimension.  Turned back, the signs are a
direction u near the vector; stored beside the code are the vector's part along
u and its part across u.  For an anchor q the inner product is

    along * <q, u>  +-  across * sqrt(|q|^2 - <q, u>^2)

by Cauchy-Schwarz, so the interval is certain, not likely.  <q, u> is estimated
by popcounts of the code against ``PLANES`` bit planes of the rotated anchor,
and the planes' rounding widens the interval by its length.  Only rows whose
interval can still matter are scored, in whole numbers, so results are exact.

First an anchor's positives are found among the rows of its label, then for
each positive the rows of other labels inside its window.  The rows are dealt
in blocks by content, once for each step; all anchors stream past a block, so a
task holds one block and one batch of anchors.  A row that is repeated counts
at most as often as results can take it, so copies never fill a block.

Defined results: vectors that are null, or hold a null or non-finite component,
and rows without an id or label take no part; shorter vectors count as padded
with zeros; rows with the anchor's id are no positives of it; repeated rows are
separate positives and negatives, equal anchors are answered once; a positive
score below zero has no window; an empty table gives no rows; extra columns are
ignored.  A hundred times a score must stay below 2**63, a component below 2**53.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.llm.tables import small_batches
from rallylens.llm.topk import matrix
from rallylens.storage import landed

SPREAD = 4
PLANES = 6
FIRST = 32  # rows scored at once to learn how good a score must be
LOW, HIGH = 80, 100  # hundredths of the positive's score


def labelled(rows: DataFrame, label: Column, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label and v (array of long) of the usable rows."""
    v = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & label.isNotNull() & usable)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def rotations(width: int, seed: int = 42) -> np.ndarray:
    """SPREAD orthogonal matrices above each other; columns have length 1."""
    rng = np.random.default_rng(seed)
    turned = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(SPREAD)]
    return np.concatenate(turned) / np.sqrt(SPREAD)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code words, parts along and across the code's direction, length of the code vector."""
    high = x @ turn.T >= 0
    back = np.where(high, 1.0, -1.0) @ turn / np.sqrt(len(turn))
    length = np.linalg.norm(back, axis=1)
    along = np.einsum("ij,ij->i", x, back) / np.maximum(length, 1e-300)
    across = np.sqrt(np.maximum((x * x).sum(axis=1) - along * along, 0.0))
    return words(high), along, across, length


class Query:
    """An anchor's rotated components in bit planes; ``off`` bounds what rounding moved."""

    def __init__(self, q: np.ndarray, turn: np.ndarray):
        z = turn @ q
        self.low, high = float(z.min()), float(z.max())
        self.step = max((high - self.low) / (2**PLANES - 1), 1e-300)
        levels = np.rint((z - self.low) / self.step).astype(np.uint8)
        near = self.low + self.step * levels
        self.off = float(np.linalg.norm(z - near))
        self.sum = float(near.sum())
        self.planes = words(np.stack([(levels >> p) & 1 for p in range(PLANES)]))
        self.norm2 = float(q @ q)
        self.root = np.sqrt(len(z))

    def interval(self, block: Block, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, least and most of the inner product with each row."""
        code = block.code[rows]
        count = np.zeros(len(code))
        for p, plane in enumerate(self.planes):
            count += (1 << p) * np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64)
        ones = self.low * block.ones[rows] + self.step * count
        along, across, length = block.along[rows], block.across[rows], np.maximum(block.length[rows], 1e-300)
        t, off = (2 * ones - self.sum) / self.root / length, self.off / length
        least = np.maximum(np.abs(t) - off, 0.0)
        estimate = along * t
        wide = np.abs(along) * off + across * np.sqrt(np.maximum(self.norm2 - least * least, 0.0))
        wide += 1e-9 * (np.abs(estimate) + wide) + 1e-6
        return estimate, estimate - wide, estimate + wide


class Block:
    """The rows of one block, by label."""

    def __init__(self, parts: list[pa.RecordBatch], width: int):
        rows = pa.Table.from_batches(parts).combine_chunks()
        rows = rows.take(pa.array(np.argsort(rows["label"].to_numpy(), kind="stable")))
        self.label, self.ids = rows["label"].to_numpy(), rows["vec_id"].to_numpy()
        self.v = matrix(rows["v"], width).astype(np.int64)
        self.code = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype="<u8").reshape(len(rows), -1)
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        self.along, self.across, self.length = (rows[c].to_numpy() for c in ("along", "across", "length"))

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """The k best ids and scores, ties by id."""
    top = np.lexsort((ids, -scores))[:k]
    return zip(ids[top].tolist(), scores[top].tolist(), strict=True)


def positives_in(block: Block, anchor: dict, q: Query, k: int) -> list[tuple]:
    """The k best rows of the anchor's label."""
    part = block.of(anchor["label"])
    other = np.flatnonzero(block.ids[part] != anchor["vec_id"]) + part.start
    if not len(other):
        return []
    estimate, _, most = (x[other - part.start] for x in q.interval(block, part))
    v = anchor["v"]
    if len(other) > FIRST:
        first = other[np.argpartition(-estimate, FIRST - 1)[: max(FIRST, k)]]
        if len(first) >= k:
            sure = np.partition(block.v[first] @ v, len(first) - k)[len(first) - k]
            other = other[most >= sure]
    return [(i, s, None, None) for i, s in best(block.v[other] @ v, block.ids[other], k)]


def negatives_in(block: Block, anchor: dict, q: Query, k: int) -> list[tuple]:
    """For each of the anchor's positives the k best rows of other labels inside its window."""
    own = block.of(anchor["label"])
    estimate, low, high = q.interval(block, slice(None))
    free = np.ones(len(estimate), dtype=bool)
    free[own] = False
    v, found = anchor["v"], []
    for nth, p in enumerate(anchor["best"]):
        score = p["score"]
        if score < 0:
            continue
        at = np.flatnonzero(free & (HIGH * high >= LOW * score) & (low <= score))
        if len(at) > FIRST:
            near = np.where(estimate[at] <= score, estimate[at], -np.inf)
            tried = block.v[at[np.argpartition(-near, FIRST - 1)[: max(FIRST, k)]]] @ v
            inside = np.sort(tried[(tried <= score) & (HIGH * tried >= LOW * score)])
            if len(inside) >= k:
                at = at[high[at] >= inside[-k]]
        scores = block.v[at] @ v
        good = (scores <= score) & (HIGH * scores >= LOW * score)
        found += [(i, s, nth, p["vec_id"]) for i, s in best(scores[good], block.ids[at[good]], k)]
    return found


FOUND = "anchor_id long, anchor_key long, vec_id long, score long, nth int, positive_id long"
SCHEMA = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("nth", pa.int32()), ("positive_id", pa.int64())])


def streamed(body: Callable[[Block, dict, Query, int], list[tuple]], width: int, turn: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by block, a block's own rows before its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            found = []
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if start == stop:
                    continue
                if blocks[start] != at:
                    at, parts, block = blocks[start], [], None
                piece = batch.slice(start, stop - start)
                if not asks[start]:
                    parts.append(piece)
                    continue
                if block is None and parts:
                    block, parts = Block(parts, width), []
                if block is None:
                    continue
                v = matrix(piece.column("v"), width)
                others = piece.select(["vec_id", "anchor_key", "label", "best"]).to_pylist()
                for anchor, q in zip(others, v, strict=True):
                    told = body(block, anchor | {"v": q.astype(np.int64)}, Query(q, turn), k)
                    found += [(anchor["vec_id"], anchor["anchor_key"], *t) for t in told]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(SCHEMA)], schema=SCHEMA)

    return run


CODE = T.StructType([T.StructField("code", T.BinaryType()), *[T.StructField(c, T.DoubleType()) for c in ("along", "across", "length")]])


def coded(rows: DataFrame, width: int, turn: np.ndarray) -> DataFrame:
    """``rows`` with code, along, across, length."""

    @F.arrow_udf(CODE)
    def code(v: pa.Array) -> pa.Array:
        bits, *rest = codes(matrix(v, width), turn)
        return pa.StructArray.from_arrays([pa.array([b.tobytes() for b in bits], pa.binary()), *map(pa.array, rest)], ["code", "along", "across", "length"])

    return rows.withColumn("c", code.asNondeterministic()("v")).select(*rows.columns, "c.*")


BEST = "array<struct<vec_id:bigint,score:bigint>>"


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, block: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` as ``labelled`` gives them; the anchors are those where ``anchor`` holds.
    """
    spark = rows.sparkSession
    small_batches(spark)
    most = max(positives, negatives)
    single = rows.groupBy("vec_id", "label", "v").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("copies"))
    single = landed(single, "vectors")
    size = single.agg(F.max(F.size("v")).alias("width"), F.sum("copies").alias("rows")).first()
    width, blocks = max(size.width or 1, 1), max(1, -(-(size.rows or 0) // block))
    turn = rotations(width)
    key = F.xxhash64("label", "v")
    data = coded(single, width, turn).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    data = landed(data.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")), "codes")
    asked = single.where(anchor).select("vec_id", "label", "v", key.alias("anchor_key"))

    def met(asking: DataFrame, body: Callable, k: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        sent = asking.select("vec_id", "label", "v", "anchor_key", "best", F.lit(True).alias("asks"), every)
        both = data.withColumn("asks", F.lit(False)).unionByName(sent, allowMissingColumns=True)
        both = both.repartition(blocks, "block").sortWithinPartitions("block", "asks")
        return both.mapInArrow(streamed(body, width, turn, k), FOUND)

    found = met(asked.withColumn("best", F.lit(None).cast(BEST)), positives_in, positives)
    order = [F.col("score").desc(), "vec_id"]
    ranked = found.withColumn("nth", F.row_number().over(W.partitionBy("anchor_id", "anchor_key").orderBy(*order))).where(F.col("nth") <= positives)
    chosen = ranked.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("p"))
    chosen = chosen.select(F.col("anchor_id").alias("vec_id"), "anchor_key", F.transform("p", lambda p: F.struct(p["vec_id"].alias("vec_id"), p["score"].alias("score"))).alias("best"))
    asking = landed(asked.join(chosen, ["vec_id", "anchor_key"]), "anchors")

    found = met(asking, negatives_in, negatives)
    whose = W.partitionBy("anchor_id", "anchor_key", "nth").orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(whose)).where(F.col("rank") <= negatives)
    score = asking.select(F.col("vec_id").alias("anchor_id"), "anchor_key", F.posexplode("best").alias("nth", "p")).select("anchor_id", "anchor_key", "nth", F.col("p.score").alias("positive_score"))
    told = ranked.join(score, ["anchor_id", "anchor_key", "nth"])
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
