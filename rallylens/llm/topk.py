"""Exact top-k inner products by dual-tree search over cover trees.

The upper level of the tree is shared: pivots, far apart, from a bounded sample;
every row, data or query, belongs to its nearest pivot, and each group's
covering radius is taken over all its rows.  A group of queries meets a group
of data only if the bound on their inner products,
``cq.cd + |cq| rd + |cd| rq + rq rd``, reaches the worst k-th score the queries
are sure of (from the sample).  Groups are dealt in blocks of bounded size, and
in each block both sides get their own cover trees, whose nodes split by
farthest points until each child covers its rows with a clearly smaller radius.
Pairs of nodes are visited best bound first and dropped against the query
node's worst k-th score so far; leaves are matrix products.  Bounds only drop
what lies strictly below, so ties and results are exact.

Memory: a task holds one block of data and one of queries.  Equal rows are
reduced to the k that a query can take, and blocks are dealt by id and vector,
so no repeated row or id fills a block.  The driver holds
the sample and one row per pivot.

Defined results: vectors that are null, or hold a null or non-finite component,
and rows without an id take no part; shorter vectors count as padded with
zeros; rows of the query's own id are no candidates of it; repeated rows are
separate candidates, equal query rows are answered once; a query gets all
candidates if there are fewer than k; an empty table gives no rows; extra
columns are ignored.  Scores must stay below 2**53.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallylens.storage import landed

LEAF = 64
SHRINK = 1.3
FAN = 16


def quantised(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v (array of long) of the usable rows."""
    v = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & usable)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def far_points(x: np.ndarray, most: int, within: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres by farthest-first traversal, each row's centre and its distance."""
    centres = [0]
    dist = np.linalg.norm(x - x[0], axis=1)
    owner = np.zeros(len(x), dtype=np.int64)
    while len(centres) < most and dist.max() > within:
        far = int(dist.argmax())
        new = np.linalg.norm(x - x[far], axis=1)
        owner[new < dist] = len(centres)
        dist = np.minimum(dist, new)
        centres.append(far)
    return centres, owner, dist


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    length: float  # of the centre
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: int = 0) -> Node:
    """A node covers its rows from one of them; children split by farthest points."""
    rows = np.arange(len(x)) if rows is None else rows
    c = x[centre]
    own = x[rows]
    radius = float(np.linalg.norm(own - c, axis=1).max())
    node = Node(rows, c, radius, float(np.linalg.norm(c)))
    if len(rows) > LEAF and radius > 0:
        first = int(np.flatnonzero(rows == centre)[0])
        order = np.concatenate([[first], np.delete(np.arange(len(rows)), first)])
        centres, owner, _ = far_points(own[order], FAN, radius / SHRINK)
        for k, at in enumerate(centres):
            node.children.append(cover_tree(x, rows[order[owner == k]], int(rows[order[at]])))
    return node


def bound(q: Node, d: Node) -> float:
    """No inner product of a row of ``q`` and a row of ``d`` exceeds this."""
    most = float(q.centre @ d.centre) + q.length * d.radius + d.length * q.radius + q.radius * d.radius
    return most + 1e-9 * abs(most) + 1e-6


class Best:
    """The k best scores and ids of every query of a block."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, sure: np.ndarray, k: int):
        self.q, self.q_ids, self.d, self.d_ids, self.k = q, q_ids, d, d_ids, k
        self.scores = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.worst = sure.copy()

    def leaves(self, qr: np.ndarray, dr: np.ndarray) -> None:
        found = self.q[qr] @ self.d[dr].T
        found[self.q_ids[qr][:, None] == self.d_ids[dr][None, :]] = -np.inf
        some = (found >= self.worst[qr][:, None]).any(axis=1)
        if not some.any():
            return
        qr, found = qr[some], found[some]
        scores = np.hstack([self.scores[qr], found])
        ids = np.hstack([self.ids[qr], np.broadcast_to(self.d_ids[dr], found.shape)])
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
        self.scores[qr] = np.take_along_axis(scores, order, 1)
        self.ids[qr] = np.take_along_axis(ids, order, 1)
        self.worst[qr] = np.maximum(self.worst[qr], self.scores[qr, -1])

    def search(self, q: Node, d: Node) -> None:
        """Visit pairs of nodes, best bound first."""
        tie = count()
        heap = [(-bound(q, d), next(tie), q, d)]
        while heap:
            most, _, q, d = heapq.heappop(heap)
            if -most < self.worst[q.rows].min():
                continue
            if not q.children and not d.children:
                for at in range(0, len(d.rows), 4096):
                    self.leaves(q.rows, d.rows[at : at + 4096])
                continue
            split_q = q.children and (not d.children or q.radius >= d.radius)
            for a, b in [(c, d) for c in q.children] if split_q else [(q, c) for c in d.children]:
                most = bound(a, b)
                if most >= self.worst[a.rows].min():
                    heapq.heappush(heap, (-most, next(tie), a, b))


@dataclass
class Pivots:
    centres: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    width: int


def choose_pivots(rows: DataFrame, most: int, sample_size: int) -> Pivots:
    """Far points of a sample of at most ``sample_size`` rows, drawn by hash order."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_size).toArrow()
    sample = matrix(drawn["v"], width) if len(drawn) else np.zeros((0, width))
    centres = far_points(sample, most)[0] if len(sample) else []
    return Pivots(sample[centres], sample, drawn["vec_id"].to_numpy(), width)


def nearest_pivot(v: Column | str, pivots: Pivots) -> Column:
    """Number of the nearest pivot and the distance to it."""
    kind = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("d", T.DoubleType())])

    @F.arrow_udf(kind)
    def nearest(column: pa.Array) -> pa.Array:
        x = matrix(column, pivots.width)
        square = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.centres.T + (pivots.centres**2).sum(axis=1)[None, :]
        g = square.argmin(axis=1)
        d = np.linalg.norm(x - pivots.centres[g], axis=1)
        return pa.StructArray.from_arrays([pa.array(g, pa.int32()), pa.array(d, pa.float64())], ["g", "d"])

    return nearest.asNondeterministic()(v)


def sure_score(query_id: Column | str, v: Column | str, pivots: Pivots, k: int) -> Column:
    """The k-th best score a query has in the sample alone."""

    @F.arrow_udf(T.DoubleType())
    def sure(ids: pa.Array, column: pa.Array) -> pa.Array:
        found = matrix(column, pivots.width) @ pivots.sample.T
        found[ids.to_numpy()[:, None] == pivots.sample_ids[None, :]] = -np.inf
        if found.shape[1] < k:
            return pa.array(np.full(len(found), -np.inf))
        return pa.array(-np.partition(-found, k - 1, axis=1)[:, k - 1])

    return sure.asNondeterministic()(query_id, v)


FOUND = "query_id long, q_key long, vec_id long, score long"


def search(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 64, sample_size: int = 2048, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query.

    ``rows`` and ``queries``: vec_id and v, as ``quantised`` gives them.
    """
    spark = rows.sparkSession
    top = choose_pivots(rows, pivots, sample_size)
    if not len(top.centres):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    single = rows.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))  # no query takes more
    each = single.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    data = landed(each.withColumn("p", nearest_pivot("v", top)).select("vec_id", "v", "p.g", "p.d"), "vectors")
    asked = queries.dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("q_key"), "v")
    asked = asked.withColumn("p", nearest_pivot("v", top)).withColumn("sure", sure_score("query_id", "v", top, k))
    asked = landed(asked.select("query_id", "q_key", "v", "p.g", "p.d", "sure"), "queries")
    groups = {r.g: r for r in data.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()}
    q_groups = asked.groupBy("g").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.min("sure").alias("sure")).collect()
    blocks = {g: -(-r.n // block) for g, r in groups.items()}
    chunks = max(1, -(-sum(r.n for r in q_groups) // block))
    node = {g: Node(np.zeros(0), top.centres[g], 0.0, float(np.linalg.norm(top.centres[g]))) for g in range(len(top.centres))}
    pairs = [
        (q.g, g, blocks[g])
        for q in q_groups
        for g, d in groups.items()
        if bound(Node(node[q.g].rows, node[q.g].centre, q.r, node[q.g].length), Node(node[g].rows, node[g].centre, d.r, node[g].length)) >= q.sure
    ]  # at most pivots x pivots
    meets = spark.createDataFrame(pairs, "q_g int, g int, blocks int")
    salts = F.element_at(F.array(*[F.lit(blocks.get(g, 1)) for g in range(len(top.centres))]), F.col("g") + 1)
    part = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    left = data.select("g", F.pmod(F.xxhash64("vec_id", "v"), salts).cast("int").alias("block"), part.alias("chunk"), "vec_id", "v")
    sent = asked.withColumnRenamed("g", "q_g").join(F.broadcast(meets), "q_g").drop("q_g", "d")
    sent = sent.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk"), "query_id", "q_key", "v", "sure")
    width = top.width

    def meet(d: pa.Table, q: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("q_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(d) or not len(q):
            return schema.empty_table()
        dx, qx = matrix(d["v"], width), matrix(q["v"], width)
        q_ids = q["query_id"].to_numpy()
        best = Best(qx, q_ids, dx, d["vec_id"].to_numpy(), q["sure"].to_numpy(), k)
        best.search(cover_tree(qx), cover_tree(dx))
        at, nth = np.nonzero((best.scores > -np.inf) & (best.scores >= q["sure"].to_numpy()[:, None]))
        columns = [q_ids[at], q["q_key"].to_numpy()[at], best.ids[at, nth], best.scores[at, nth].astype(np.int64)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    keys = ["g", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, FOUND)
    order = W.partitionBy("query_id", "q_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
