"""Prefix trie of conversations: nodes are distinct openings, with what sharing them would save.

Whole sequences are collapsed first: conversations that are equal from end to end become one
weighted sequence with a list of its ends. Sequences that are proper prefixes of others go by an
anti-join, what stays are the leaves. Then the openings of the weighted sequences are aggregated.

A node is (depth, 128 bits): each turn is hashed together with its place, and the hashes up to a
turn are joined by exclusive or, a running window. Sums over subtrees are linear in the turns:
every sequence adds what it holds from a node on; where words count once a node and not once a
conversation, each node is counted with the smallest leaf below it, whose own nodes are always the
end of its path.

Turns of one place are ordered by role and text. Null roles and texts are empty; rows without a
conv_id belong to no conversation and are left out; repeated rows are turns of their own. An empty
table has no nodes. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import staged

#: Conversations of a block, whose first one lends its opening turns, and the modulus of how many those are.
BLOCK, HEADS = 20, 4
KEY = ("depth", "k1", "k2")
#: Bytes of ids that travel in one row.
PART = 1 << 20
WORD = "[^\\x20\\x09-\\x0D]+"


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of every turn; place counts from 1 in each conversation."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return turns.select("conv_id", place.cast("long").alias("place"), "role", "text")


def signed(turns: DataFrame) -> DataFrame:
    """turns with 128 bits of each role and text and the number of its words in their place."""
    return turns.select("conv_id", "place", F.xxhash64("role", "text").alias("x1"), F.xxhash64("text", F.lit(1), "role").alias("x2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with the opening of its block's first one in place of its own: (conv_id, depth, other columns of turns).

    Depth counts from 1; each conversation has a row of depth 0 too, with nulls, turns or not. turns is read several times.
    """
    more = [c for c in turns.columns if c not in ("conv_id", "place")]
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    of = lambda c: c - c % BLOCK
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    first = sizes.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    info = sizes.select("conv_id", of(F.col("conv_id")).alias("base"), heads.alias("own")).join(first, "base", "left").select("conv_id", "base", "own", F.least("own", F.coalesce("there", F.lit(0))).alias("lent"))
    kept = turns.join(info.drop("base"), "conv_id").where("place > own").select("conv_id", (F.col("place") - F.col("own") + F.col("lent")).alias("depth"), *more)
    opening = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv_id", "base")
    lent = opening.join(info.where("lent > 0"), "base").where("place <= lent").select("conv_id", F.col("place").alias("depth"), *more)
    roots = info.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in more])
    return kept.unionByName(lent).unionByName(roots)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, before, total, length): the node of every turn of rebuilt(signed(...)), its parent's bits, words before it, and words and turns of the conversation."""
    there = F.col("depth") > 0
    terms = turns.select("conv_id", "depth", F.when(there, F.xxhash64("x1", "depth")).otherwise(0).alias("t1"), F.when(there, F.xxhash64("x2", "depth", F.lit(1))).otherwise(0).alias("t2"), F.coalesce("words", F.lit(0)).alias("words"))
    own = Window.partitionBy("conv_id").orderBy("depth")
    upto, all_ = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = terms.withColumns({"k1": F.bit_xor("t1").over(upto), "k2": F.bit_xor("t2").over(upto), "upto": F.sum("words").over(upto), "total": F.sum("words").over(all_), "length": F.max("depth").over(all_)})
    return found.select("conv_id", *KEY, F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "words", (F.col("upto") - F.col("words")).alias("before"), "total", "length")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the conv_ids that end at a node, ascending, joined by commas.

    Ids are joined to strings of at most PART bytes in ranges of (node, id), so a node of very many ends is spread; its strings then pass through one digest in order.
    """
    schema = "depth long, k1 long, k2 long, first long, ids string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": [key[0]], "k1": [key[1]], "k2": [key[2]], "first": [first], "ids": [",".join(ids)]}, schema=pa.schema([*[(c, pa.int64()) for c in (*KEY, "first")], ("ids", pa.string())]))

        for batch in batches:
            out = []
            for *node, conv_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if node != key or size > PART:
                    if ids:
                        out.append(row())
                    key, first, ids, size = node, conv_id, [], 0
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else []
        if ids:
            yield row()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        rows: list[list] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict(dict(zip((*KEY, "ends_sha256"), zip(*rows, strict=True), strict=True)), schema=pa.schema([*[(c, pa.int64()) for c in KEY], ("ends_sha256", pa.string())]))
            rows.clear()
            return out

        for batch in batches:
            for *node, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if node == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    rows.append([*key, digest.hexdigest()])
                key, digest = node, hashlib.sha256(ids.encode())
            if rows:
                yield flush()
        if key is not None:
            rows.append([*key, digest.hexdigest()])
            yield flush()

    ids = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(joined, schema)
    return ids.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digested, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of rebuilt(signed(...)): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    (conv_id, depth) names a node too: its text is that of the turn of this depth in this conversation (node_turns).
    """
    path = staged(paths(turns), "paths")
    ends = path.where("depth = length")
    sequences = staged(ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "sequences")
    own = path.join(sequences.select("conv_id", "weight"), "conv_id")
    inner = own.where("depth < length").select(*KEY).distinct()
    leaves = sequences.join(inner, list(KEY), "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    marked = staged(own.join(leaves, "conv_id", "left"), "weighted")
    nodes = marked.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("owner"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("before").alias("before"), F.sum(F.col("weight") * (F.col("total") - F.col("before"))).alias("spent"),
    )
    nodes = staged(nodes, "nodes")
    since = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("before").alias("since"))
    once = marked.where("leaf = 1").join(since, "conv_id").groupBy(*KEY).agg(F.sum(F.col("total") - F.greatest("before", "since")).alias("once"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    # the root has most children, and its conversation is known without a join
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    top = nodes.where("depth = 0").select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    named = nodes.where("depth > 1").join(parents, ["depth", "p1", "p2"], "left").unionByName(nodes.where("depth <= 1").join(F.broadcast(top), "depth", "left"))
    key = list(KEY)
    joined = named.join(once, key).join(children, key, "left").join(end_digests(ends), key, "left")
    return joined.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("spent") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """nodes with role and text of their last turn, from rebuilt(ordered(...)); nulls at the root."""
    return nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")
