"""Alignment of two tokenizers' ids over the bytes of each text, by pointer jumping.

Tokenizer A (byte-level) encodes a space and the text, tokenizer B (pieces) the text, before which it puts
the space itself. Both cut the same bytes. Every token points to the farthest-right token that overlaps it (of two
with one end, to A's); successors are doubled, ``next = next[next]`` over the whole array, until nothing
changes. Each token then points to the last token of its component, which labels the group: the
shortest runs of A and B tokens with the same bytes. All tokens of many texts go through one array; a text's
chunks (see chunks.py) share no token, so each distinct chunk is aligned once and texts are put together from
their chunks.

A link is a pair of an A and a B token occurrence whose bytes overlap. ``align`` returns per document n_a, n_b,
n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) on demand, groups_sha256, and by the corpus-wide
counts (in how many documents an id pair is linked) count_sum and n_best. ``pair_counts`` is that table.

Texts run in blocks of about BLOCK_BYTES. A block has a dictionary of its distinct pairs; its documents
hold indexes into it, so one row per (block, pair) meets the counts, not one per (document, pair): the counts
come back to the block by a join on the pair and a grouping by block. A pair that all documents hold
has one row per block. Blocks are written to the shared folder first. The best count of each A id is broadcast:
one row per vocabulary slot.

Cases: a null or empty text, or one whose tokens do not give back its bytes (U+2581, which B reads as a space),
has no tokens: zeros, '' for groups and its digest; null and repeated doc_ids are documents of their own, each counted; an
empty table gives no row; texts of any length go whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.llm.chunks import STORE_CHUNKS, STORE_IDS, Chunks, Lists, byte_pieces, filled, groups, load_tokenizer, of_worker, safe_cuts
from groupcast.llm.common import arrow_rows, cut, shared_path

BLOCK_BYTES = 6_000_000
BLOCKS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "held binary, times binary, pair long, docs long"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
)


def last_of_component(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens that cut the same bytes (given by their ends): the A token at which each A and each B
    token's component ends. Pointer jumping with doubling."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    n = len(a_ends)
    far = np.searchsorted(b_starts, a_ends, "left") - 1  # the last B token that starts before the A token's end
    hop_a = np.where(b_ends[far] > a_ends, n + far, np.arange(n))
    hop_b = np.searchsorted(a_starts, b_ends, "left") - 1
    hop = np.concatenate([hop_a, hop_b])
    while True:
        twice = hop[hop]
        if np.array_equal(twice, hop):
            return hop[:n], hop[n:]
        hop = twice


class Aligner:
    """Chunks and their alignment, remembered by a worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = load_tokenizer(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = byte_pieces(self.a)
        size = self.b.get_piece_size()
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(size)))
        ]
        self.len_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.len_b = np.fromiter(map(len, self.bytes_b), np.int64)
        self.name_a = [b"%d" % i for i in range(len(self.bytes_a))]
        self.name_b = [b"%d" % i for i in range(size)]
        self.cuts = safe_cuts(p for i, p in enumerate(self.bytes_b) if not self.b.is_byte(i))
        if b" " not in self.cuts:
            self.cuts = b""
        # A chunk may start with anything but B's own space: it goes in behind a known text that no piece crosses.
        self.head = self.b.encode("a")
        self.fresh()

    def fresh(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.said: list[bytes] = []
        self.sound = np.empty(0, dtype=bool)
        self.counts = np.empty((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        self.pairs, self.times = Lists("<i8"), Lists("<i8")

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """The ids of chunks. One that starts with a space is what B makes of the rest; others start at a cut."""
        spaced = [c[0] == " " and len(c) > 1 for c in chunks]
        got = self.b.encode([c[1:] if s else "a" + c for c, s in zip(chunks, spaced, strict=True)], num_threads=1)
        return [x if s else x[len(self.head) :] for x, s in zip(got, spaced, strict=True)]

    def learn(self, words: list[bytes]) -> None:
        if len(self.rows) > STORE_CHUNKS or len(self.pairs.flat) > STORE_IDS:
            self.fresh()
        new = [w for w in words if w not in self.rows]
        for at in range(0, len(new), 8192):
            self._learn(new[at : at + 8192])

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.encode_b(texts)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        sound = np.array([b"".join(map(of_a, x)) == w == b"".join(map(of_b, y)) for w, x, y in zip(words, a, b, strict=True)], dtype=bool)
        empty: list[int] = []
        a = [x if s else empty for x, s in zip(a, sound, strict=True)]
        b = [x if s else empty for x, s in zip(b, sound, strict=True)]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a = np.fromiter((i for x in a for i in x), np.int64, int(n_a.sum()))
        ids_b = np.fromiter((i for x in b for i in x), np.int64, int(n_b.sum()))
        first = len(self.rows)
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))
        self.sound = np.concatenate([self.sound, sound])
        n_groups, n_links, texts_of, pairs, times, sizes = self._align(ids_a, ids_b, n_a, n_b)
        self.said += texts_of
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, n_links], axis=1)])
        self.pairs.add(pairs, sizes)
        self.times.add(times, sizes)

    def _align(self, ids_a, ids_b, n_a, n_b):
        """Groups and links of chunks laid end to end."""
        n = len(n_a)
        chunk_a = np.repeat(np.arange(n), n_a)
        zero = np.zeros(n, dtype=np.int64)
        if not len(ids_a):
            return zero, zero, [b""] * n, np.empty(0, np.int64), np.empty(0, np.int64), zero
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        last_a, last_b = last_of_component(ends_a, ends_b)
        # Groups in order: their last A tokens, and where their A and B tokens start.
        lasts, from_a = np.unique(last_a, return_index=True)
        from_b = np.searchsorted(last_b, lasts)
        n_groups = np.bincount(chunk_a[lasts], minlength=n)
        names_a, names_b = [self.name_a[i] for i in ids_a.tolist()], [self.name_b[i] for i in ids_b.tolist()]
        stops_a, stops_b = [*from_a[1:].tolist(), len(ids_a)], [*from_b[1:].tolist(), len(ids_b)]
        said = [
            b",".join(names_a[p:q]) + b"|" + b",".join(names_b[r:s])
            for p, q, r, s in zip(from_a.tolist(), stops_a, from_b.tolist(), stops_b, strict=True)
        ]
        bounds = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        texts = [b";".join(said[p:q]) for p, q in zip(bounds, bounds[1:], strict=False)]
        # Links: an A token overlaps a run of B tokens.
        low = np.searchsorted(ends_b, ends_a - self.len_a[ids_a], "right")
        high = np.searchsorted(ends_b - self.len_b[ids_b], ends_a, "left")
        reach = high - low
        n_links = np.bincount(chunk_a, weights=reach, minlength=n).astype(np.int64)
        before = np.cumsum(reach) - reach
        to = np.repeat(low - before, reach) + np.arange(int(reach.sum()))
        pair = (np.repeat(ids_a, reach) << 32) | ids_b[to]
        chunk = np.repeat(chunk_a, reach)
        order = np.lexsort((pair, chunk))
        pair, chunk = pair[order], chunk[order]
        new = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(chunk) != 0)])
        at = np.flatnonzero(new)
        return n_groups, n_links, texts, pair[at], np.diff(np.append(at, len(pair))), np.bincount(chunk[at], minlength=n)

    def block(self, texts: pa.Array, block: int, doc_ids: pa.Array, keep_groups: bool) -> pa.RecordBatch:
        """One block's rows: its documents, then its dictionary of pairs with the number of documents that hold each."""
        got = Chunks(filled(texts, " "), self.cuts)
        self.learn(got.words)
        rows = np.fromiter(map(self.rows.__getitem__, got.words), np.int64, len(got.words))
        n, codes, bounds = len(texts), got.codes, got.bounds
        doc = np.repeat(np.arange(n), np.diff(bounds))
        empty = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) == 0
        unsound = np.bincount(doc[~self.sound[rows][codes]], minlength=n) > 0
        sound = ~(empty | unsound)
        sums = np.zeros((n, 4), dtype=np.int64)
        per = self.counts[rows][codes]
        for k in range(4):
            total = np.concatenate([[0], np.cumsum(per[:, k])])
            sums[:, k] = np.where(sound, total[bounds[1:]] - total[bounds[:-1]], 0)
        names = [self.said[r] for r in rows.tolist()]
        whole = codes.tolist()
        groups_of = [
            b";".join([names[c] for c in whole[p:q]]) if s else b""
            for p, q, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), sound.tolist(), strict=True)
        ]
        digests = [hashlib.sha256(g).hexdigest() if s else "" for g, s in zip(groups_of, sound.tolist(), strict=True)]
        held, times, stops, dictionary, docs = self._pairs_of_documents(doc, codes, rows, sound, n)
        m = len(dictionary)
        nothing = lambda kind: pa.nulls(m, kind)
        columns = [
            pa.array(np.full(n + m, block)),
            pa.concat_arrays([doc_ids, nothing(pa.int64())]),
            *(pa.concat_arrays([pa.array(sums[:, k]), nothing(pa.int64())]) for k in range(4)),
            pa.array(digests + [None] * m, pa.string()),
            pa.array([g.decode() for g in groups_of] + [None] * m if keep_groups else [None] * (n + m), pa.string()),
            pa.array(_packed(held, stops) + [None] * m, pa.binary()),
            pa.array(_packed(times, stops, gaps=False) + [None] * m, pa.binary()),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(dictionary)]),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(docs)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])

    def _pairs_of_documents(self, doc, codes, rows, sound, n):
        """Per document its distinct pairs (indexes into the block's sorted dictionary) and how often each is linked."""
        use = sound[doc]
        both, count = np.unique(doc[use] * max(1, len(rows)) + codes[use], return_counts=True)
        doc, code = both // max(1, len(rows)), both % max(1, len(rows))
        spots, sizes = self.pairs.spots(rows)
        dictionary, place = np.unique(self.pairs.flat[spots], return_inverse=True)
        # A list per distinct chunk of the block, as places in the dictionary.
        local, weight = Lists("<i8"), Lists("<i8")
        local.add(place, sizes)
        weight.add(self.times.flat[spots], sizes)
        spots, sizes = local.spots(code)
        key = np.repeat(doc, sizes) * max(1, len(dictionary)) + local.flat[spots]
        times = weight.flat[spots] * np.repeat(count, sizes)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(key) else np.empty(0, np.int64)
        times = np.add.reduceat(times[order], at) if len(at) else np.empty(0, np.int64)
        key = key[at]
        held = key % max(1, len(dictionary))
        stops = np.searchsorted(key // max(1, len(dictionary)), np.arange(n + 1))
        docs = np.bincount(held, minlength=len(dictionary))
        used = docs > 0  # pairs of unsound documents alone fall away
        return (np.cumsum(used) - 1)[held], times, stops, dictionary[used], docs[used]


def _packed(values: np.ndarray, stops: np.ndarray, gaps: bool = True) -> list[bytes]:
    """Each document's numbers in the narrowest of 1, 2, 4 and 8 bytes, that width first; rising ones as their gaps."""
    out = []
    for p, q in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        part = np.diff(values[p:q], prepend=0) if gaps else values[p:q]
        top = int(part.max()) if len(part) else 0
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        out.append(bytes([width]) + part.astype(f"<u{width}").tobytes())
    return out


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """The rows of BLOCKS for all documents, written to the shared folder: one per document (pair null) and one per
    distinct pair of a block (docs: how many of its documents hold the pair)."""
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        aligner = of_worker((path_a, path_b), lambda: Aligner(path_a, path_b))
        block = TaskContext.get().partitionId() << 32
        for rows in groups(batches, "text", BLOCK_BYTES):
            yield aligner.block(rows.column("text").combine_chunks(), block, rows.column("doc_id").combine_chunks(), keep_groups)
            block += 1

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)
    path = shared_path(spark, "blocks")
    with arrow_rows(spark, 1024):
        made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), n (documents corpus-wide that hold it linked), best (n is its A id's highest)."""
    held = cut(blocks.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("n")), "pairs")
    top = held.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))  # one row per slot of A's vocabulary
    return held.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """The columns of RESULT, one row per document; ``groups`` is null unless kept."""
    blocks = aligned_blocks(docs, path_a, path_b, keep_groups)
    back = blocks.where("pair IS NOT NULL").select(F.col("block").alias("of"), "pair").join(pair_counts(blocks), "pair")
    texts = blocks.where("pair IS NULL").drop("pair", "docs")

    def run(key, left, right):
        if not left.num_rows:
            return _result(left, np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(right.column("pair").to_numpy())
        n = right.column("n").to_numpy()[order]
        best = right.column("best").to_numpy()[order]
        total, hits = [], []
        for held, times in zip(left.column("held").to_pylist(), left.column("times").to_pylist(), strict=True):
            at, often = np.cumsum(_numbers(held)), _numbers(times)
            total.append(int((n[at] * often).sum()))
            hits.append(int(often[best[at]].sum()))
        return _result(left, np.asarray(hits), np.asarray(total))

    return texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, RESULT)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _result(left: pa.Table, hits: np.ndarray, total: np.ndarray) -> pa.Table:
    return pa.table(
        {
            **{c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": pa.array(hits, pa.int64()), "count_sum": pa.array(total, pa.int64()),
            **{c: left.column(c) for c in ("groups_sha256", "groups")},
        }
    )
