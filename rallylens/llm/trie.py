"""Prefix trie of conversations by collapse of whole sequences.

Identical conversations are one weighted sequence with the list of those that
end there.  Only the prefixes of distinct sequences are aggregated, each with
its sequence's weight, so a group of copies of any size costs one sequence.  A
sequence that is a proper prefix of another is dropped by an anti-join; what is
left are the leaves.

A prefix is named by 128 bits of hashes of (position, turn), added up along the
conversation in cells of positions, so a conversation of any length is spread
over many tasks.  What a node's subtree holds is summed without listing
ancestors: members' characters come from weights and lengths; the characters of
distinct nodes are counted by the node's smallest member.  The nodes with one
smallest member are a suffix of its path, so every sequence gives each of its
prefixes one number.

The list of ends is hashed by a stream sorted by sequence and id, in pieces of
up to 1,024 ids: a SHA-256 is one after the other by nature, but no list is held.

Defined results: a null role or text is empty; rows are ordered by turn, ties by
role, then text, nulls first; equal rows are separate turns; rows without
conv_id belong to no conversation; an empty table gives no rows; extra columns
are ignored.  Up to 2**31 turns a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallylens.llm.ranks import numbered, running
from rallylens.llm.tables import small_batches
from rallylens.storage import landed

LANES = ["s0", "s1", "s2", "s3"]
ENDS_BITS = 10


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, k (from 1), said (a hash of role and text), chars: every turn in order, landed."""
    told = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said")
    return landed(numbered(told, "conv_id", ["turn", "role", "text"], [said, F.length("text").cast("long").alias("chars")]), "turns")


def rebuilt(said: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of their block's first one.

    Conversation c takes the first h turns of c - c % block, h = crc32(c) %
    heads, then its own after its first h.  Returns the ids, and their turns:
    conv_id, depth (from 1), said, chars.
    """
    c = F.col("conv_id")
    first = said.where((c % block == 0) & (F.col("k") < heads)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "said", "chars"))).alias("head"))
    ids = said.select("conv_id").distinct()
    wanted = ids.select("conv_id", (c - c % block).alias("base"), (F.crc32(c.cast("string")) % heads).alias("h"))
    taken = F.slice("head", F.lit(1), F.col("h").cast("int"))
    told = landed(wanted.join(first.withColumnRenamed("conv_id", "base"), "base", "left").select("conv_id", "h", F.when(F.col("head").isNull(), F.array().cast(first.schema["head"].dataType)).otherwise(taken).alias("head")), "heads")
    shared = told.select("conv_id", F.inline("head")).select("conv_id", F.col("k").alias("depth"), "said", "chars")
    own = said.join(told.select("conv_id", "h", F.size("head").alias("b")), "conv_id").where(F.col("k") > F.col("h"))
    return told.select("conv_id"), landed(shared.unionByName(own.select("conv_id", (F.col("k") - F.col("h") + F.col("b")).alias("depth"), "said", "chars")), "rebuilt")


def named(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *sums)))


def root() -> Column:
    return named(F.lit(0), [F.lit(0)] * len(LANES))


def prefixes(said: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, chars, before (code points above the node) of every prefix, landed."""
    mixed = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "said"), 256)
    lane = {s: F.conv(F.substring(mixed, 8 * i + 1, 8), 16, 10).cast("long") for i, s in enumerate(LANES)}
    summed = running(said.select("conv_id", "depth", "chars", *[x.alias(s) for s, x in lane.items()]), "conv_id", "depth", [*LANES, "chars"])
    node = named(F.col("depth"), [F.col(f"sum_{s}") for s in LANES])
    parent = named(F.col("depth") - 1, [F.col(f"sum_{s}") - F.col(s) for s in LANES])
    return landed(summed.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "chars", (F.col("sum_chars") - F.col("chars")).alias("before")), "prefixes")


def ends_hashed(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 from ends (node, conv_id): the ids ascending, comma-joined."""
    piece = F.shiftright("conv_id", ENDS_BITS).alias("piece")
    told = ends.groupBy("node", piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], schema=schema)

    small_batches(ends.sparkSession)
    return told.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(hashed, "node binary, ends_sha256 string")


def trie(ids: DataFrame, said: DataFrame) -> DataFrame:
    """The nodes of conversations given by their ids and turns (conv_id, depth, said, chars).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    paths = prefixes(said)
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("last"), F.sum("chars").alias("chars"))
    whole = ids.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.node", root()).alias("node"), F.coalesce("last.depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("chars", F.lit(0)).alias("chars")
    )
    whole = landed(whole, "conversations")
    collapsed = whole.groupBy("node", "depth", "chars").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    sequences = landed(collapsed.select("first", "n", F.col("node").alias("end"), F.col("depth").alias("length"), F.col("chars").alias("total")), "sequences")

    below = paths.join(sequences, paths["conv_id"] == sequences["first"]).select("first", "n", "end", "length", "total", "depth", "node", "parent", "chars", "before")
    none = F.lit(0).cast("long")
    roots = sequences.select("*", none.alias("depth"), root().alias("node"), F.lit(None).cast("binary").alias("parent"), none.alias("chars"), none.alias("before"))
    every = landed(below.unionByName(roots), "weighted")
    leaves = sequences.join(every.where("depth < length").select(F.col("node").alias("end")).distinct(), "end", "left_anti").select("first", F.lit(1).alias("leaf"))

    nodes = every.groupBy("node", "parent", "depth", "chars", "before").agg(
        F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.col("n") * F.col("total")).alias("said")
    )
    nodes = landed(nodes, "nodes")
    owners = landed(nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("o")).select("conv_id", F.col("o.before").alias("base")), "owners")
    given = sequences.select("first", "total").join(owners.withColumnRenamed("conv_id", "first"), "first", "left").join(leaves, "first", "left")
    given = given.select("first", F.coalesce(F.col("total") - F.col("base"), none).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = every.select("first", "node").join(given, "first").groupBy("node").agg(F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))

    told = nodes.join(sums, "node").join(children, "node", "left").join(ends_hashed(whole.select("node", "conv_id")), "node", "left")
    told = told.join(parents, "parent", "left").join(owners, "conv_id")
    repeated = F.col("said") - F.col("n_convs") * F.col("before")  # characters of the members at and below the node
    distinct = F.col("own") - F.col("before") + F.col("base")  # and of the nodes
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        (repeated - distinct).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
