"""Texts as runs of independent chunks, so that a tokenizer sees each distinct chunk once.

A chunk starts at a text's start, at every space or line feed that follows a character
other than white space, and at every mark (ASCII punctuation) that follows a letter or digit.
A byte-level tokenizer's pattern ends a pre-token at these places; a piece tokenizer never
merges over them if no piece of its vocabulary holds such a place, which ``safe_cuts`` checks.
So the ids of a text are those of its chunks in order.

Chunks are found with numpy over the UTF-8 bytes of an Arrow column and told apart by
Arrow's dictionary encoding; only a batch's distinct chunks are looked at in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The ASCII bytes that some tokenizer's patterns take as white space.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
SPACES = b" \n"
#: All ASCII punctuation but the bar, which special tokens hold behind a letter.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"
CUTS = SPACES + MARKS
#: Bytes of ASCII letters and digits; second bytes (after 0xC3) of the Latin-1 letters.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[[*b"0123456789", *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LATIN = np.zeros(256, dtype=bool)
LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: Chunks and ids that a worker remembers; beyond either it starts anew.
STORE_CHUNKS = 600_000
STORE_IDS = 4_000_000


def safe_cuts(pieces: Iterable[bytes]) -> bytes:
    """The bytes that no piece holds where a chunk would start."""
    bad = set()
    for p in pieces:
        bad.update(b for a, b in zip(p, p[1:], strict=False) if b in SPACES and not WHITE[a])
        bad.update(b for a, b in zip(p, p[1:], strict=False) if b in MARKS and (PLAIN[a] or a >= 0x80))
    return bytes(b for b in CUTS if b not in bad)


def _wide_white(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character that ends at these places (above ASCII) may be white space:
    U+0085 U+00A0 U+1680 U+2000-200A U+2028 U+2029 U+202F U+205F U+3000."""
    c = data[end]
    b = data[np.maximum(end - 1, 0)]
    a = data[np.maximum(end - 2, 0)]
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    e2 = (a == 0xE2) & (
        ((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))
    )
    return two | e2 | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


class Chunks:
    """The chunks of a group of texts: ``words`` (distinct, bytes), ``codes`` (an index into words
    per chunk, in order) and ``bounds`` (text i holds the chunks bounds[i] to bounds[i + 1])."""

    def __init__(self, texts: pa.Array, cuts: bytes = CUTS):
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype="<i4", count=texts.offset + n + 1)[texts.offset :] if n else np.zeros(1, "<i4")
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
        offsets = (offsets - low).astype(np.int64)
        starts = np.zeros(len(data), dtype=bool)
        if len(data):
            spaces, marks = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
            spaces[[b for b in cuts if b in SPACES]] = True
            marks[[b for b in cuts if b in MARKS]] = True
            at = np.flatnonzero(spaces[data[1:]] & ~WHITE[data[:-1]]) + 1
            wide = data[at - 1] >= 0x80
            if wide.any():
                odd = np.flatnonzero(wide)
                at = np.delete(at, odd[_wide_white(data, at[odd] - 1)])
            starts[at] = True
            at = np.flatnonzero(marks[data])
            at = at[at > 0]
            before = data[at - 1]
            starts[at[PLAIN[before] | (LATIN[before] & (data[np.maximum(at - 2, 0)] == 0xC3))]] = True
            starts[offsets[:-1][np.diff(offsets) > 0]] = True
        begin = np.flatnonzero(starts)
        ends = np.append(begin, len(data)).astype("<i4")
        chunks = pa.Array.from_buffers(
            pa.binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]
        ).dictionary_encode()
        self.words: list[bytes] = chunks.dictionary.to_pylist()
        self.codes: np.ndarray = chunks.indices.to_numpy(zero_copy_only=False)
        self.bounds: np.ndarray = np.searchsorted(begin, offsets)


class Lists:
    """Growing lists of numbers per row: ``flat`` and the offsets ``at``."""

    def __init__(self, dtype):
        self.flat = np.empty(0, dtype=dtype)
        self.at = np.zeros(1, dtype=np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes, dtype=np.int64)])

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.at[rows + 1] - self.at[rows]

    def spots(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``flat`` of these rows' numbers, row after row, and the rows' sizes."""
        sizes = self.sizes(rows)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(self.at[rows] - ends + sizes, sizes) + np.arange(total), sizes


def byte_pieces(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer. Its alphabet writes printable Latin-1 characters as
    themselves and the other bytes, in order, as the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    letters = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(other)}
    vocabulary = tokenizer.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


def of_worker(key: tuple, make: Callable):
    """What ``make`` returns, made once per Python worker and kept from task to task."""
    import sys
    import types

    kept = sys.modules.setdefault("_chunks_of_worker", types.ModuleType("_chunks_of_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Encoder:
    """ids of texts by ``encode`` (a list of chunks to a list of id lists), each distinct chunk once.

    Chunks that match WHOLE are encoded many in one text, where ``joined`` can tell their ids apart."""

    WHOLE: re.Pattern | None = None

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], cuts: bytes):
        self.encode, self.cuts = encode, cuts
        self.rows: dict[bytes, int] = {}
        self.ids = Lists("<u4")

    def joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of these chunks, encoded as one text, and how many each has; None if they cannot be told apart."""
        return None

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.ids.add(ids, sizes)

    def learn(self, words: list[bytes]) -> None:
        if len(self.rows) > STORE_CHUNKS or len(self.ids.flat) > STORE_IDS:
            self.rows, self.ids = {}, Lists("<u4")
        new = [w for w in words if w not in self.rows]
        apart = new
        if self.WHOLE is not None:
            whole, apart = [], []
            for w in new:
                (whole if self.WHOLE.fullmatch(w) else apart).append(w)
            for at in range(0, len(whole), 4096):
                part = whole[at : at + 4096]
                got = self.joined(part)
                if got is None:
                    apart += part
                else:
                    self._add(part, *got)
        for at in range(0, len(apart), 4096):
            part = apart[at : at + 4096]
            lists = self.encode([w.decode() for w in part])
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self._add(part, np.fromiter((i for x in lists for i in x), "<u4", int(sizes.sum())), sizes)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the bounds of each text's ids."""
        got = Chunks(texts, self.cuts)
        self.learn(got.words)
        at = np.fromiter(map(self.rows.__getitem__, got.words), np.int64, len(got.words))
        spots, sizes = self.ids.spots(at[got.codes])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids.flat[spots], ends[got.bounds]


class ByteEncoder(Encoder):
    """Encoder of a byte-level tokenizer file. Chunks that start with white space and end with another character
    are told apart by their bytes."""

    WHOLE = re.compile(rb"[ \n].*(?:[!-~]|\xc3[\x80-\xbf])", re.S)

    def __init__(self, path: str):
        tok = load_tokenizer(path)
        super().__init__(lambda words: [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)], CUTS)
        self.lengths = np.fromiter(map(len, byte_pieces(tok)), np.int64)

    def joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.asarray(self.encode([b"".join(words).decode()])[0], dtype="<u4")
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        have = np.cumsum(self.lengths[ids])
        stops = np.searchsorted(have, ends) + 1
        if stops[-1] == len(ids) and (have[stops - 1] == ends).all():
            return ids, np.diff(stops, prepend=0)
        return None


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def filled(texts: pa.Array, prefix: str = "") -> pa.Array:
    """The texts with nulls as empty ones, a prefix put before each."""
    out = pc.fill_null(texts.cast(pa.string()), "")
    return pc.binary_join_element_wise(prefix, out, "") if prefix else out


def groups(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows of a task's batches again, in order, in tables that close once their texts reach ``limit``
    bytes (one text may be larger)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first, before = 0, 0
        while first < b.num_rows:
            stop = min(b.num_rows, int(np.searchsorted(ends, before + limit - size)) + 1)
            held.append(b.slice(first, stop - first))
            size += int(ends[stop - 1]) - before
            first, before = stop, int(ends[stop - 1])
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
