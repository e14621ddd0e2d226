"""Packing documents into fixed-length training sequences: first-fit decreasing per randomised group.

A document is its token ids and an end id. Whole runs of ``capacity`` ids are cut off its front; each
is a sequence by itself. The rests go to randomised groups of about GROUP_DOCS documents, by a hash of
their place in the table (no value decides, so copies and repeated ids spread). A group packs alone:
its rests, longest first, each go into the first sequence with room for them, found in a tournament
tree whose leaves are the sequences' free room and whose inner nodes hold the larger child. Then
the gaps left are closed: the emptiest sequences give their last, smallest pieces to the fullest ones, the
last of them cut to size. One sequence per group may stay open; it is cut at powers of two, the lengths that
need no padding. So every sequence holds ``capacity`` ids or a power of two of them.

``pack`` returns one row per piece: doc_id, start (ids of its document before it), length, doc_tokens
(with the end id), sequence_id, offset (in its sequence), ids (little-endian uint32). Sequence ids are unique,
not dense: even for the runs cut off, odd for packed rests (group and number).

Encoding runs first and is written to the shared folder, so groups and sequences rest on rows that a
lost executor cannot change. A task holds one group: some MB, whatever the size of the table.

Cases: a null or empty text is the end id alone; null and repeated doc_ids are documents of their own, so
their pieces share an id; of equally long rests the earlier row goes first; a text of any length is
encoded whole; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.llm.chunks import ByteEncoder, filled, groups, of_worker
from groupcast.llm.common import arrow_rows, shared_path

CAPACITY = 1024
GROUP_DOCS = 4096
GROUP_BYTES = 4_000_000
SEED = 17
#: Pieces in one batch that goes back to Spark
PART = 4096
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class RoomTree:
    """Tournament tree over the free room of up to ``n`` sequences, all empty at first."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.node = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first sequence with room for ``size``; takes the room."""
        node, at = self.node, 1
        while at < self.leaves:
            at *= 2
            if node[at] < size:
                at += 1
        found = at - self.leaves
        node[at] -= size
        at //= 2
        while at:
            best = max(node[2 * at], node[2 * at + 1])
            if node[at] == best:
                break
            node[at] = best
            at //= 2
        return found


def first_fit(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length) for sizes in the order of placement."""
    tree, out = RoomTree(len(sizes), capacity), []
    for item, size in enumerate(sizes):
        at = tree.place(size)
        if at == len(out):
            out.append([])
        out[at].append((item, 0, size))
    return out


def close_gaps(sequences: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The emptiest sequences' last pieces fill the fullest ones; what stays open is cut at powers of two."""
    room = [capacity - sum(p[2] for p in s) for s in sequences]
    done = [s for s, r in zip(sequences, room, strict=True) if not r]
    order = sorted((k for k, r in enumerate(room) if r), key=lambda k: (room[k], k))
    still = [(list(sequences[k]), room[k]) for k in order]
    low, high = 0, len(still) - 1
    while low < high:
        target, need = still[low]
        giver, _ = still[high]
        while need and giver:
            item, start, length = giver.pop()
            take = min(need, length)
            if take < length:
                giver.append((item, start, length - take))
            target.append((item, start + length - take, take))
            need -= take
        if need:
            still[low] = (target, need)
        else:
            done.append(target)
            low += 1
        if not giver:
            high -= 1
    if low == high and still[low][0]:
        done += powers_of_two(still[low][0])
    return done


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One open sequence as several whose lengths are the powers of two that sum to its length."""
    total = sum(p[2] for p in pieces)
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need = total & (1 << bit)
        part = []
        while need:
            item, start, length = left.pop()
            take = min(need, length)
            if take < length:
                left.append((item, start + take, length - take))
            part.append((item, start, take))
            need -= take
        if part:
            out.append(part)
    return out


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Documents as runs of ``capacity`` ids (with a sequence_id) and rests (without), written to the shared
    folder: the columns of PIECES and ``place``, a number of the document's row."""
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        encode = of_worker(("bytes", tokenizer_path), lambda: ByteEncoder(tokenizer_path))
        place = TaskContext.get().partitionId() << 32
        runs = place
        for rows in groups(batches, "text", GROUP_BYTES):
            ids, bounds = encode(filled(rows.column("text").combine_chunks()))
            n = np.diff(bounds) + 1  # with the end id
            after = np.cumsum(n)
            whole = np.empty(int(after[-1]), dtype="<u4")
            end = np.zeros(len(whole), dtype=bool)
            end[after - 1] = True
            whole[end], whole[~end] = end_id, ids
            # Every document in pieces of ``capacity`` ids; the last may be shorter.
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(capacity, n[doc] - start)
            full = length == capacity
            number = runs + np.cumsum(full) - 1
            runs += int(full.sum())
            at = np.concatenate([[0], np.cumsum(length) * 4])
            ids_of_docs = rows.column("doc_id").combine_chunks()
            for a in range(0, len(doc), PART):
                b = min(len(doc), a + PART)
                raw = whole[at[a] // 4 : at[b] // 4].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_of_docs.take(pa.array(doc[a:b])), pa.array(start[a:b]), pa.array(length[a:b]), pa.array(n[doc[a:b]]),
                        pa.array(2 * number[a:b], mask=~full[a:b]), pa.array(np.zeros(b - a, np.int64)),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at[a : b + 1] - at[a]).astype("<i4").tobytes()), pa.py_buffer(raw)]),
                        pa.array(place + doc[a:b]),
                    ],
                    names=[*(c.split()[0] for c in PIECES.split(", ")), "place"],
                )
            place += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = shared_path(spark, "runs")
    made = rows.mapInArrow(run, f"{PIECES}, place long")
    with arrow_rows(spark, 1024):
        made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, seed: int = SEED) -> DataFrame:
    """Pieces (the columns of PIECES) of all documents in sequences of at most ``capacity`` ids."""
    made = encoded(docs, tokenizer_path, end_id, capacity)
    rests = made.where("sequence_id IS NULL")
    n = max(1, -(-rests.count() // GROUP_DOCS))

    def run(key, table):
        group = key[0].as_py()
        length, place = table.column("length").to_numpy(), table.column("place").to_numpy()
        order = np.lexsort((place, -length))
        sequences = close_gaps(first_fit(length[order].tolist(), capacity), capacity)
        flat = [(number, *piece) for number, sequence in enumerate(sequences) for piece in sequence]
        number, item, cut, size = (np.array(c, dtype=np.int64) for c in zip(*flat, strict=True))
        offset = np.cumsum(size) - size
        first = np.concatenate([[True], np.diff(number) > 0])
        offset -= np.repeat(offset[first], np.diff(np.append(np.flatnonzero(first), len(number))))
        row = order[item]
        of = table.take(pa.array(row))
        ids = [raw[4 * a : 4 * (a + b)] for raw, a, b in zip(of.column("ids").to_pylist(), cut.tolist(), size.tolist(), strict=True)]
        return pa.table(
            {
                "doc_id": of.column("doc_id"), "start": of.column("start").to_numpy() + cut, "length": size,
                "doc_tokens": of.column("doc_tokens"), "sequence_id": 2 * ((group << 32) + number) + 1,
                "offset": offset, "ids": pa.array(ids, pa.binary()),
            }
        )

    dealt = rests.withColumn("grp", F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(n)))
    packed = dealt.groupBy("grp").applyInArrow(run, PIECES)
    return made.where("sequence_id IS NOT NULL").drop("place").unionByName(packed)
