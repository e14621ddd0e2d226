"""Alignment against a token-by-token brute force on whole texts."""

import collections
import functools
import hashlib
import random

import numpy as np
import pytest

from groupcast.llm import tokenizer_alignment as ta
from groupcast.llm.queries import tokenizer_path
from tests.llm.data import frame, rows

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ALPHABET = [" ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", " ", "a", "Bc", "é", "ß", "'s", "'re", "1", "23", ".", "!!", "),",
            "<|endoftext|>", "<s>", "</s>", "<0x41>", "漢字", "😀", "▁", "\x00", "ﬁ", "​", "word", " the", ";\r"]


def odd(n=400):
    rng = random.Random(2)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return [(1000 + i, t, "en", "s") for i, t in enumerate(out)]


@functools.cache
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, ta.byte_pieces(a), sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    a, pieces, b = tokenizers()
    raw = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [pieces[i] for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], []
    spans = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, out = 0, []
        for i, p in zip(ids, parts, strict=True):
            out.append((i, at, at + len(p)))
            at += len(p)
        spans.append(out)
    return spans


def brute(table):
    """Per row of the table: everything but what counts need, and its links."""
    out = []
    for doc_id, text, *_ in table:
        a, b = tokens(text) if text else ([], [])
        cuts = {e for _, _, e in a} & {e for _, _, e in b}
        groups, at = [], 0
        for end in sorted(cuts):
            groups.append(",".join(str(i) for i, s, e in a if at <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in b if at <= s and e <= end))
            at = end
        links = []
        for i, s, e in a:
            links += [(i, j) for j, p, q in b if s < q and p < e]
        said = ";".join(groups)
        out.append((doc_id, len(a), len(b), len(groups), said, links))
    docs = collections.Counter(p for *_, links in out for p in set(links))
    top = collections.defaultdict(int)
    for (i, _), n in docs.items():
        top[i] = max(top[i], n)
    return [
        (d, n_a, n_b, n_g, len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links),
         hashlib.sha256(said.encode()).hexdigest() if n_a else "", said)
        for d, n_a, n_b, n_g, said, links in out
    ]


def got(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [6_000_000, 3_000])
def test_alignment_is_that_of_whole_texts(spark, monkeypatch, block):
    monkeypatch.setattr(ta, "BLOCK_BYTES", block)
    table = [r if r[0] != 306 else (306, r[1][:4000], *r[2:]) for r in rows() if r[0] != 305] + [(305, "x" * 3000, "en", "s")] + odd()
    want = brute(table)
    assert sum(w[1] == 0 for w in want) > 20 and any(w[3] > 50 for w in want)
    assert got(ta.align(frame(spark, table), A, B, keep_groups=True)) == sorted(want, key=str)


def test_tables_without_tokens(spark):
    docs = frame(spark)
    assert ta.align(docs.limit(0), A, B).count() == 0
    none = [(1, None, None, None), (1, "", "en", "s"), (None, "▁", "en", "s")]
    assert got(ta.align(frame(spark, none), A, B)) == sorted([(d, 0, 0, 0, 0, 0, 0, "", None) for d, *_ in none], key=str)


def test_pointer_jumping_on_random_cuts():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 60)
        ends = [np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n})) for _ in range(2)]
        last_a, last_b = ta.last_of_component(*ends)
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        for e, last in zip((*ends[0], *ends[1]), (*last_a, *last_b), strict=True):
            assert ends[0][last] == next(c for c in cuts if c >= e)


def test_query_has_the_documents(spark):
    from groupcast.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    df = queries()["op11_tokenizer_alignment"](spark, sf)
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 3000]
    seen = {r.doc_id: r for r in df.collect()}
    for w in brute(table):
        r = seen[w[0]]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*w[1:5], w[7])
