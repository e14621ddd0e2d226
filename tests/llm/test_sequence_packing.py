"""Packing against the tokenizer on whole texts and a plain first-fit decreasing."""

import collections
import functools
import random
import zlib

import numpy as np
import pytest

from groupcast.llm import sequence_packing as sp
from groupcast.llm.queries import tokenizer_path
from tests.llm.data import frame, rows

VOCABULARY = tokenizer_path("byte_bpe_50k.json")
ODD = [
    (400, " lead and trail \n\n x\t\ty ", "en", "s"), (401, "a  b   c　\n d", "en", "s"),
    (402, "<|endoftext|> x<|endoftext|>y", "en", "s"), (403, "don't, it's: 12,5 (a) é, ß. ñ!", "en", "s"),
    (404, "\x00\x1c \x1c\n", "en", "s"), (405, "漢字、かな。\n漢 字", "zh", "s"),
]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def whole_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, table, capacity):
    want = collections.Counter((i, tuple(whole_ids(t))) for i, t, *_ in table)
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.start, p.doc_tokens, ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    # Documents that share an id: their pieces, each whole text matched once.
    for doc_id, parts in docs.items():
        texts = sorted((k[1] for k, n in want.items() if k[0] == doc_id for _ in range(n)), key=len)
        assert sum(len(x[2]) for x in parts) == sum(map(len, texts))
        if len(texts) == 1:
            ids, at = [], 0
            for start, total, part in sorted(parts):
                assert (start, total) == (at, len(texts[0]))
                ids += part
                at += len(part)
            assert tuple(ids) == texts[0]
    assert set(docs) == {i for i, *_ in table}


@pytest.mark.parametrize(("capacity", "group"), [(1024, 4096), (64, 16)])
def test_pieces_give_back_every_document(spark, monkeypatch, capacity, group):
    monkeypatch.setattr(sp, "GROUP_DOCS", group)
    table = rows() + ODD
    check(sp.pack(frame(spark, table), VOCABULARY, capacity=capacity).collect(), table, capacity)


def test_reruns_agree_and_empty_table(spark):
    docs = frame(spark)
    seen = [sorted((p.sequence_id, p.offset, p.doc_id or -1, p.start, p.length) for p in sp.pack(docs, VOCABULARY).collect()) for _ in range(2)]
    assert seen[0] == seen[1]
    assert sp.pack(docs.limit(0), VOCABULARY).count() == 0


def test_tree_places_as_first_fit():
    rng = random.Random(5)
    for n in (1, 2, 3, 50, 257):
        sizes = sorted((rng.choice([1, 7, 500, 512, 1023, rng.randint(1, 1023)]) for _ in range(n)), reverse=True)
        room, want = [], []
        for item, size in enumerate(sizes):
            at = next((k for k, r in enumerate(room) if r >= size), len(room))
            if at == len(room):
                room.append(1024)
                want.append([])
            room[at] -= size
            want[at].append((item, 0, size))
        assert sp.first_fit(sizes, 1024) == want
        closed = sp.close_gaps(want, 1024)
        held = [sum(p[2] for p in s) for s in closed]
        assert sum(held) == sum(sizes) and all(h & (h - 1) == 0 for h in held)
        assert sum(h < 1024 for h in held) <= 10
        ids = sorted((i, a + k) for s in closed for i, a, b in s for k in range(b))
        assert ids == [(i, k) for i, size in enumerate(sizes) for k in range(size)]


def test_query_digests(spark):
    from groupcast.llm.queries import queries

    got = queries()["op13_sequence_packing"](spark, "/root/testdata/sf0.001")
    assert got.columns[:3] == ["doc_id", "start", "length"]
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encoded = {i: np.asarray(whole_ids(t), "<u4") for i, t in texts.items()}
    for p in got.collect():
        part = encoded[p.doc_id][p.start : p.start + p.length]
        assert (len(encoded[p.doc_id]), zlib.crc32(part.tobytes())) == (p.doc_tokens, p.ids_crc32)
