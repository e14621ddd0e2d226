"""Prefix trie of conversations by whole-sequence collapse.

A turn is known by a digest of its role and text, taken where the row lies: texts are never shuffled. Each
conversation's turns, in order, become a chain of keys (key = digest of the key before and the turn), read from
sorted partitions as a stream, so a conversation of any length needs no array. Then

1. conversations with one last key are one weighted sequence: its smallest id, how many, and their ids (the end list);
2. the prefixes of each distinct sequence are its representative's chain, weighted;
3. a sequence whose last key no other sequence passes through is a leaf (anti-join with the proper prefixes);
4. weighted prefixes are added up per key: members, leaves, code points.

``saved_tokens`` needs no walk: over a subtree the sum of n_convs * chars is, per sequence, its weight times the code
points from the node on; the sum of chars counts each node once, at the sequence that owns it, the one with
the smallest id. What a sequence owns is the end of its path, so this too is one number per prefix.

An end list is hashed as a stream: ids are dealt by ranges of (key, id), joined into segments where they
lie, and the segments of a key, in order, go through one SHA-256. So the copies of one conversation may be a
third of the table. Sums and counts are combined before each shuffle; the one join on a key that may be hot (a
node's parent) has one row on the other side, so adaptive execution splits it.

``rebuilt`` gives conversations a common start: the first h turns of conversation c - c % SHARE, h = crc32(c) % HEADS,
then their own from the h-th on (% as in SQL: with the sign of c).

Cases: null roles and texts are empty; rows of equal turn go in order of their digest, null turns first; repeated rows are
turns of their own; rows with a null conv_id belong to no conversation and are left out; a conversation may end up without turns
and then ends at the root; an empty table has no root and gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from groupcast.llm.common import cut

SHARE, HEADS = 100, 6
ROOT = bytes(16)
SEGMENT = 1 << 16
CHAIN = "conv_id long, depth long, key binary, parent binary, chars long, before long, last boolean"


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, ...), said (digest of role and text), chars (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("said"),
        F.length(text).cast("long").alias("chars"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "said")
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "said", "chars")


def rebuilt(rows: DataFrame) -> DataFrame:
    """The turns of the rebuilt conversations as ``numbered`` gives them, and per conversation a row with pos -1."""
    turns = cut(numbered(rows), "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    every = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARE).alias("base"), head.alias("h"))
    # At most HEADS - 1 turns of a conversation, for fewer than 2 * SHARE others.
    first = turns.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base")
    heads = every.join(first, "base").where("pos < h").select("conv_id", "pos", "said", "chars")
    marks = every.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("chars"))
    return heads.union(turns.where(F.col("pos") >= head)).union(marks)


def _chain(batches):
    """Rows sorted by (conv_id, pos) to CHAIN; a row leaves when the next one shows whether it is its conversation's last."""
    names = [c.split()[0] for c in CHAIN.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    held = None
    for b in batches:
        out: list[tuple] = []
        for conv, pos, said, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "pos", "said", "chars")), strict=True):
            if pos < 0:
                row = (conv, 0, ROOT, None, 0, 0)
            else:
                _, depth, key, _, size, before = held
                row = (conv, depth + 1, hashlib.sha256(key + said).digest()[:16], key, chars, before + size)
            if held is not None:
                out.append((*held, pos < 0))
            held = row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*held, True), kinds, strict=True)], names=names)


def chains(turns: DataFrame) -> DataFrame:
    """CHAIN: one row per prefix of each conversation, the root (depth 0) included."""
    return cut(turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_chain, CHAIN), "chains")


def _segments(batches):
    """Rows sorted by (key, conv_id) to pieces of the end lists: key, first id, ids joined by commas."""
    key, ids, size = None, [], 0

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"]
        )

    for b in batches:
        for k, conv in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or size >= SEGMENT):
                yield out()
                ids, size = [], 0
            key = k
            ids.append(conv)
            size += 8
    if ids:
        yield out()


def _hashed(batches):
    """Segments sorted by (key, first) to the digest of each key's whole list."""
    key, digest = None, None

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done])], names=["key", "ends_sha256"])

    for b in batches:
        done = []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield rows(done)
    if digest is not None:
        yield rows([(key, digest.hexdigest())])


def end_lists(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of rows (key, conv_id): the ids of a key, ascending, joined by commas."""
    dealt = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = dealt.mapInArrow(_segments, "key binary, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    chain = chains(turns)
    ends = chain.where("last").select("key", "conv_id", F.col("depth").alias("length"), (F.col("before") + F.col("chars")).alias("total"))
    sequences = ends.groupBy("key").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.max("length").alias("length"), F.max("total").alias("total")
    )
    prefixes = cut(
        chain.select(F.col("conv_id").alias("rep"), "depth", "key", "parent", "chars", "before")
        .join(sequences.drop("key"), "rep"),
        "prefixes",
    )
    through = prefixes.where("depth < length").select("key").distinct()
    leaves = prefixes.where("depth = length").select("rep", "key").join(through, "key", "left_anti").select("rep", F.lit(1).alias("leaf"))
    nodes = cut(
        prefixes.join(leaves, "rep", "left")
        .groupBy("key")
        .agg(
            F.min("rep").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.max("parent").alias("parent"),
            F.max("before").alias("before"),
            F.sum("weight").alias("n_convs"),
            F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
            F.sum(F.col("weight") * (F.col("total") - F.col("before"))).alias("all_chars"),
        ),
        "nodes",
    )
    # The first node that a sequence owns; from there on the path is its own.
    own = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.min("before").alias("owned"))
    once = prefixes.join(own, "rep").groupBy("key").agg(F.sum(F.col("total") - F.greatest("before", "owned")).alias("once"))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(once, "key", "left")
        .join(children, "key", "left")
        .join(end_lists(ends.select("key", "conv_id")), "key", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
            (F.col("all_chars") - F.coalesce("once", F.lit(0))).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
