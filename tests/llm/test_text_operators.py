"""Operators over documents against brute force on a table of awkward cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupcast.llm.queries import tokenizer_path
from tests.llm.data import edited, frame, lower, rows, texts

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = SPACE.findall(lower(text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def groups(table):
    """doc_id -> smallest linked id, by comparing all pairs."""
    sets = collections.defaultdict(list)
    for i, t, *_ in table:
        if i is not None:
            sets[i].append(shingles(t))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if both and 100 * both >= 90 * len(x | y):
                        p, q = root(a), root(b)
                        up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("page", [256, 8])
def test_jaccard_groups(spark, monkeypatch, page):
    from groupcast.llm import jaccard_tree

    monkeypatch.setattr(jaccard_tree, "PAGE", page)  # 8: blocks of several pages
    monkeypatch.setattr(jaccard_tree, "PART_SIGNATURES", page)  # 8: a task's signatures in many parts
    want = groups(rows())
    got = jaccard_tree.link_documents(frame(spark)).collect()
    assert len(got) == len(rows())
    by_id = collections.defaultdict(list)
    for i, t, *_ in rows():
        by_id[i].append(len(shingles(t)))
    for r in got:
        assert r.n_shingles in by_id[r.doc_id]
        assert r.component_id == want.get(r.doc_id)
    assert want[129] == 0 and len({want[200 + i] for i in range(40)}) < 10


def test_jaccard_segments_meet_for_every_pair_at_the_threshold():
    from groupcast.llm.jaccard_tree import segment_signatures

    rng = np.random.default_rng(1)
    for n in [*range(2, 60), 99, 100, 250, 777]:
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for removed in range(0, n // 10 + 1):
            for added in range(0, n // 9 + 1):
                both = n - removed
                if 100 * both < 90 * (n + added):
                    continue
                y = np.unique(np.concatenate([x[removed:], rng.integers(0, 2**64, added, dtype=np.uint64)]))
                if removed or added:
                    assert set(segment_signatures(x).tolist()) & set(segment_signatures(y).tolist())


def test_jaccard_keeps_one_of_each_group(spark):
    from groupcast.llm.jaccard_tree import keep_one

    docs = frame(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = groups(rows())
    assert sorted(i for i in ids if i is not None) == sorted({i for i in want if want[i] == i})
    assert ids.count(None) == 2


def test_jaccard_unlike_texts_of_one_id(spark):
    from groupcast.llm.jaccard_tree import keep_one, link_documents

    a, b, c = texts(n=3)
    table = [(3, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, a), (7, c), (8, c), (9, ""), (9, ""), (9, c), (None, a), (None, a)]
    docs = frame(spark, [(*r, "en", "s") for r in table])
    kept = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (7, c), (9, ""), (None, a), (None, a)], key=str)
    want = groups(table)
    assert {want[i] for i in (3, 5, 6, 7, 8, 9)} == {3}
    got = link_documents(docs).collect()
    assert len(got) == len(table) and all(r.component_id == want.get(r.doc_id) for r in got)


def test_empty_tables(spark):
    from groupcast.llm import decontaminate, jaccard_tree, language_id, lattice_lm, mixing, secrets, token_frames

    docs = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_tree.link_documents(docs).count() == 0
    assert jaccard_tree.keep_one(docs).count() == 0
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert decontaminate.decontaminate(frame(spark), items).where("n_hit > 0 or contaminated").count() == 0
    assert lattice_lm.lattice_scores(docs, F.lit(True), tokenizer_path()).count() == 0
    assert language_id.learn(docs, F.lit(True)) is None
    assert language_id.identify(docs, None).count() == 0
    assert {r.lang_pred for r in language_id.identify(frame(spark), None).collect()} == {"und"}
    assert secrets.report(secrets.scan(docs)).count() == 0
    sized = mixing.sized(docs)
    assert mixing.per_document(mixing.mix(sized, mixing.draw_plan(sized))).count() == 0
    assert mixing.mix_documents(docs).count() == 0
    assert token_frames.read_files(token_frames.write_files(docs, tokenizer_path())).count() == 0


def contamination(table, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall(lower(t or ""))
        if i is not None and w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(i)
    out = []
    for i, t, *_ in table:
        w = PLAIN.findall(lower(t or ""))
        hit, found = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    found |= windows[tuple(w[k : k + size])]
                    hit[k : k + size] = [1] * size
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        n = sum(hit)
        out.append((i, len(w), n, len(found), digest, n > 0 and 20 * n >= len(w)))
    return out


def test_decontamination(spark):
    from groupcast.llm.decontaminate import decontaminate, drop_contaminated

    base = texts()
    words = base[2].split()
    items = [
        (1, base[7]), (2, " ".join(words[3:25])), (3, " ".join(words[:14])), (3, "An other, ROW of the item"), (4, base[0].split()[4]),
        (5, " ".join(base[9].split()[2:9])), (6, None), (7, "?! ..."), (None, base[11]), (8, base[0].upper() + "!"), (9, "ОДИН два"),
        (10, " ".join([words[0]] * 20)),
    ]
    table = [*rows(), (400, " ".join([words[0]] * 50), None, None), (401, base[7].replace(" ", "-"), "en", "s1")]
    got = decontaminate(frame(spark, table), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(contamination(table, items), key=str)
    kept = drop_contaminated(frame(spark, table), spark.createDataFrame(items, "item_id long, text string"))
    bad = {r[0] for r in contamination(table, items) if r[5]} - {None}
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in table} - bad
    assert kept.columns == frame(spark, []).columns


def test_contaminated_rows_without_an_id_go(spark):
    from groupcast.llm.decontaminate import drop_contaminated

    base = texts()
    table = [(None, base[7], "en", "s"), (None, base[7], "en", "t"), (None, base[8], "en", "s"), (None, None, "en", "s"), (1, base[9], "en", "s"), (2, base[7], None, None)]
    items = spark.createDataFrame([(1, base[7])], "item_id long, text string")
    kept = drop_contaminated(frame(spark, table), items).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, base[8]), (None, None), (1, base[9])], key=str)


def test_lattice_sums_all_segmentations():
    from groupcast.llm.lattice_lm import Lattice, Vocabulary

    vocabulary = Vocabulary(tokenizer_path())
    rng = np.random.default_rng(0)
    lattice = Lattice(vocabulary, rng.integers(0, 50, vocabulary.slots).astype(float))

    def total(word):
        def go(i):
            if i == len(word):
                return 0.0
            out = 0.0
            for j in range(i + 1, len(word) + 1):
                table = lattice.closing if j == len(word) else lattice.inner
                if word[i:j] in table:
                    out += math.exp(table[word[i:j]]) * (go(j) if j < len(word) else 1.0)
            return out

        return math.log10(go(0))

    for word in (b"a", b"the", b"thinking,", "größe".encode(), b"xq"):
        assert abs(lattice.score(word) - total(word)) < 1e-9
    assert -1e6 < lattice.score(b"x" * 5000) < -1000
    # All strings together weigh at most one: those of one and two letters less.
    letters = [bytes([b]) for b in range(256)]
    assert sum(10 ** lattice.score(a) for a in letters) < 1


def test_lattice_scores(spark, monkeypatch):
    from groupcast.llm import lattice_lm
    from groupcast.llm.language_id import held_out

    monkeypatch.setattr(lattice_lm, "FREQUENT", 50)  # most words meet their score in the join
    got = lattice_lm.lattice_scores(frame(spark), ~held_out(remainder=1), tokenizer_path()).collect()
    counts, all_words = collections.Counter(), collections.defaultdict(list)
    for i, t, *_ in rows():
        w = [*SPACE.findall(lower(t or "")), ""]
        trains = i is None or zlib.crc32(str(i).encode()) % 5 != 1
        all_words[i].append((trains, w))
        if trains:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        fits = []
        for trains, w in all_words[r.doc_id]:
            base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            known = sum(counts[x] > 0 for x in w)
            fits.append((trains, len(w), known, n) == (r.trains, r.n_tokens, r.n_known, r.train_tokens) and abs(base - r.base_score) < 1e-6)
        assert any(fits)
        assert r.score < 0 and r.subword_score < 0
    assert len(got) == len(rows())


def test_language_id_learns_and_rejects(spark):
    from groupcast.llm.language_id import held_out, identify, keep_identified, learn

    german = "der die und nicht schön größe über straße werden können müssen"
    english = "the and not beautiful size over street become can must have"
    table = []
    for i in range(300):
        w = (german if i % 2 else english).split()
        table.append((i, " ".join(w[(i * k) % len(w)] for k in range(1, 30)), "de" if i % 2 else "en", "s"))
    table += [(1000, None, "en", None), (1001, "", "en", None), (1002, "123 !! 456", "en", None), (1003, "größe " * 50_000, None, None)]
    table += [(None, "the and not", "en", "s"), (5, table[5][1], "de", "s")]
    docs = frame(spark, table)
    model = learn(docs, ~held_out())
    got = identify(docs, model).collect()
    assert len(got) == len(table)
    for r in got:
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None and r.doc_id < 300:
            assert r.lang_pred == ("de" if r.doc_id % 2 else "en") and 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id == 1003} == {"de"}
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids.isdisjoint({1000, 1001, 1002}) and set(range(300)) <= ids


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    from groupcast.llm.token_frames import read_files, write_files

    tok = Tokenizer.from_file(tokenizer_path())
    table = [*rows(), (310, "a b c\x0bd <|endoftext|> é 'll  Iİ ΣΑΣ\r\nx", "en", "s")]
    manifest = write_files(frame(spark, table), tokenizer_path(), f"file://{tmp_path}/out")
    got = sorted(read_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in table), key=lambda i: -1 if i is None else i)
    at, left = 0, collections.defaultdict(list)
    for i, t, *_ in table:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        left[i].append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    some = read_files(manifest, wanted=[3, 305]).collect()
    assert sorted(r.doc_id for r in some) == [3, 305]
    assert {(r.doc_id, r.start) for r in some} <= {(r.doc_id, r.start) for r in got}


def test_token_file_checks_and_reads_only_what_is_asked():
    import io

    from groupcast.llm.token_frames import FrameReader, FrameWriter

    class Source(io.BytesIO):
        read_bytes = 0

        def size(self):
            return len(self.getvalue())

        def read(self, n=-1):
            got = super().read(n)
            self.read_bytes += len(got)
            return got

    out = io.BytesIO()
    writer = FrameWriter(out, frame_tokens=1000)
    rng = np.random.default_rng(0)
    docs = {i: rng.integers(0, 49000, int(rng.integers(0, 900))).astype("<u4").tobytes() for i in range(200)}
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.close()
    source = Source(out.getvalue())
    reader = FrameReader(source)
    assert {d: ids for _, d, _, ids in reader.documents()} == docs
    source.read_bytes = 0
    assert [(d, ids) for _, d, _, ids in reader.documents({77})] == [(77, docs[77])]
    assert source.read_bytes < len(out.getvalue()) / 20
    damaged = bytearray(out.getvalue())
    damaged[40] ^= 255
    with pytest.raises(Exception):
        list(FrameReader(Source(bytes(damaged))).documents())


def test_remembered_chunks_encode_as_the_library(monkeypatch):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from groupcast.llm import chunks, token_frames

    monkeypatch.setattr(chunks, "STORE_CHUNKS", 40)
    encoder, library = token_frames.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    hard = [
        "x\x0cy don't, it's. 3.5; a!! b!? «ça» naïve, Straße: Ünï cödé 😀, éa.  x y ЖЖ, 中文. ½, x²: ﬁ.",
        "A<|B", "<|ENDOFTEXT|> a", "<|endoftext|>", "x<|endoftext|>y", "", None, "...", ".,a.", "É, é. İx", edited(texts()[1], 1),
        "a=\u0338b !\u0301 e\u0301, Σας ΣΑΣ. \u00a0 x\u2028 y\u3000 z \u0085 w", "\n\n A\n b\t c \x1c d\r\n",
    ]
    rng = random.Random(4)
    letters = [" ", "\n", "\t", "\xa0", "a", "B", "é", "'s", "1", ",", "!!", "=", "\u0338", "\u0301", "<|endoftext|>", "漢", "😀", "ﬁ", "Σ", "|", "word"]
    hard += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    for _ in range(2):
        for some in (hard, texts()[:10], [hard[0]]):
            ids, bounds = encoder(chunks.filled(pa.array(some, pa.string())))
            for t, p, q in zip(some, bounds[:-1], bounds[1:], strict=True):
                assert ids[p:q].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
