"""Token files of independent zstandard frames with a trailing seek table.

File, little endian:

    frame ...     each an own zstandard frame of the token ids (uint32) of whole documents,
                  at least FRAME_TOKENS tokens unless it is the last; a document never spans frames
    index frame   a zstandard frame: per document, doc_id (int64) and number of tokens (uint64)
    seek table    per frame and for the index: compressed size, tokens, documents (uint64 each),
                  xxh3 of the uncompressed bytes (uint64)
    footer        number of entries (uint64), size of the seek table's bytes (uint64),
                  xxh3 of the seek table's bytes (uint64), magic

A reader takes the footer and seek table from the file's end, the index from its place, and then
decompresses only frames that hold requested documents, checking each against its checksum.

Texts are dealt by ranges of doc_id and sorted within a range; each range becomes one file,
written to a temporary name and moved into place, so a lost or repeated task leaves one whole
file. Texts are encoded by the tokenizers library chunk by chunk (chunks.py), each distinct one once.

Cases: a null or empty text is the end id alone; a null doc_id sorts first and is stored as the
smallest int64; documents with one id go by text; repeated rows stay; an empty table gives no file; other
columns are ignored. Files go to the store that spark.checkpoint.dir names, by pyarrow's file systems.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from groupcast.llm.chunks import CUTS, Encoder, filled, groups, load_tokenizer, of_worker
from groupcast.llm.common import ensure_dir, open_store, shared_path, small_batches

MAGIC = b"GCTOKSK1"
FRAME_TOKENS = 1 << 16
END_ID = 1
NO_ID = -(1 << 63)
FOOTER = "<QQQ8s"
ENTRY = "<QQQQ"
GROUP_BYTES = 4_000_000


class WordEncoder(Encoder):
    """Encoder of a tokenizer that lowers letters, drops white space and ends every pre-token with a piece that has
    MARK. A chunk of letters alone is one pre-token, so many of them in one text are told apart by those pieces."""

    MARK = "</w>"
    #: white space or none, then A-Z a-z and the lower-case letters of Latin-1 as UTF-8: composed, one pre-token
    WHOLE = re.compile(rb"[ \n]?(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, path: str):
        tok = load_tokenizer(path)
        super().__init__(lambda words: [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)], CUTS)
        vocab = tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith(self.MARK)]] = True

    def joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.asarray(self.encode([b" ".join(w.strip() for w in words).decode()])[0], dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(words) and stops[-1] == len(ids) else None


class FrameWriter:
    def __init__(self, out, frame_tokens: int = FRAME_TOKENS):
        import zstandard

        self.out, self.frame_tokens = out, frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.held: list[bytes] = []
        self.size = 0
        self.entries: list[bytes] = []
        self.docs: list[bytes] = []
        self.n_docs = self.tokens = 0

    def _frame(self, raw: bytes, tokens: int, docs: int) -> None:
        import xxhash

        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.entries.append(struct.pack(ENTRY, len(packed), tokens, docs, xxhash.xxh3_64_intdigest(raw)))

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // 4
        self.held.append(ids)
        self.size += n
        self.tokens += n
        self.n_docs += 1
        self.docs.append(struct.pack("<qQ", doc_id, n))
        if self.size >= self.frame_tokens:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held), self.size, len(self.held))
            self.held, self.size = [], 0

    def close(self) -> None:
        import xxhash

        self.flush()
        self._frame(b"".join(self.docs), 0, self.n_docs)
        seek = b"".join(self.entries)
        self.out.write(seek)
        self.out.write(struct.pack(FOOTER, len(self.entries), len(seek), xxhash.xxh3_64_intdigest(seek), MAGIC))


class FrameReader:
    """Random access to one file: ``source`` has seek, read and size (as pyarrow's files)."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size, tail = source.size(), struct.calcsize(FOOTER)
        n, length, check, magic = struct.unpack(FOOTER, self._at(size - tail, tail))
        if magic != MAGIC:
            raise ValueError("not a token file")
        seek = self._at(size - tail - length, length)
        if xxhash.xxh3_64_intdigest(seek) != check or length != n * struct.calcsize(ENTRY):
            raise ValueError("the seek table is damaged")
        self.entries, at = [], 0
        for e in struct.iter_unpack(ENTRY, seek):
            self.entries.append((at, *e))
            at += e[0]
        self.index = np.frombuffer(self._frame(len(self.entries) - 1), dtype=[("doc_id", "<i8"), ("n", "<u8")])

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, k: int) -> bytes:
        import xxhash

        at, size, tokens, docs, check = self.entries[k]
        raw = self.zstd.decompress(self._at(at, size), max_output_size=max(tokens * 4, docs * 16))
        if xxhash.xxh3_64_intdigest(raw) != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted=None):
        """(place in the file, doc_id, tokens before it, ids as bytes) of the wanted doc_ids, or of all."""
        first, before = 0, 0
        for k, (_, _, tokens, docs, _) in enumerate(self.entries[:-1]):
            rows = self.index[first : first + docs]
            if wanted is None or any(int(d) in wanted for d in rows["doc_id"]):
                raw, at, start = self._frame(k), 0, before
                for i, (doc_id, n) in enumerate(rows.tolist()):
                    if wanted is None or doc_id in wanted:
                        yield first + i, doc_id, start, raw[at : at + 4 * n]
                    at += 4 * n
                    start += n
            first, before = first + docs, before + tokens


def write_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write one file per range of doc_id. Runs the job; returns the
    manifest (path, first_id, n_docs, n_tokens), one row per file, itself a table in the same folder."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    folder = folder or shared_path(spark, "tokens")
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches):
        encode = of_worker(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        name, store, writer, first = f"{uuid.uuid4().hex}.tok", None, None, None
        for rows in groups(batches, "text", GROUP_BYTES):
            ids = rows.column("doc_id").to_pylist()
            if writer is None:
                first = ids[0]
                store, path = open_store(folder)
                out = store.open_output_stream(f"{path}/_{name}")
                writer = FrameWriter(out)
            codes, bounds = encode(filled(rows.column("text").combine_chunks()))
            for doc_id, p, q in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                writer.add(NO_ID if doc_id is None else doc_id, codes[p:q].tobytes() + end)
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{path}/_{name}", f"{path}/{name}")
            row = [[name], [NO_ID if first is None else first], [writer.n_docs], [writer.tokens]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["path", "first_id", "n_docs", "n_tokens"],
            )

    ensure_dir(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ranged.mapInArrow(run, "path string, first_id long, n_docs long, n_tokens long")
    manifest = f"{folder}/manifest"
    made.write.parquet(manifest)  # only the committed attempt of a task is listed
    return spark.read.schema(made.schema).parquet(manifest).withColumn("folder", F.lit(folder))


def read_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """One row per document of the files: doc_id, start (tokens of all documents before it), n_tokens,
    ids_crc32; of the wanted ids alone, if given (a bounded list; other frames stay packed)."""
    order = W.partitionBy(F.lit(1)).orderBy("first_id", "path")  # one row per file
    files = manifest.withColumn("ahead", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    small_batches(manifest.sparkSession)
    wanted = None if wanted is None else set(wanted)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                store, path = open_store(row["folder"])
                with store.open_input_file(f"{path}/{row['path']}") as source:
                    part: list[tuple] = []
                    for _, doc_id, before, raw in FrameReader(source).documents(wanted):
                        part.append((None if doc_id == NO_ID else doc_id, row["ahead"] + before, len(raw) // 4, zlib.crc32(raw)))
                        if len(part) >= 4096:
                            yield _rows(part)
                            part = []
                    yield _rows(part)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(4 * n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(part: list[tuple]):
    columns = list(zip(*part, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"]
    )
