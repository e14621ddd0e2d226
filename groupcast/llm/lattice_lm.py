"""Language-model scores by a subword lattice: log-space forward recursion over all segmentations.

A text is its words (cut at ASCII white space, A-Z lowered) and one end. Over a word stands a lattice of
pieces: those of an existing tokenizer's vocabulary, each either inside the word or closing it, and the
word itself if training rows hold it. Its probability is the sum over all ways from its start to its
end, by forward recursion in log space. Every single byte is a piece, so every word has a way.

The vocabulary file has no probabilities of its own. Pieces are counted in the library's segmentation of every
distinct training word (each word once, as the pieces are there for words not met before), plus ALPHA. The edge of a
whole word weighs its training count less DISCOUNT; what the discounts free, DISCOUNT per distinct word, goes to the
pieces. So the weights of all strings add up to one with the end's. A text's probability is the product over its
words and the end. ``subword_score`` is the same by pieces alone, with the end's weight.

Every word type is scored once: the distinct words of all documents form a table of (word, training
count, lattice score). Words of at most SHORT bytes whose count reaches the lowest power of two that leaves at most
FREQUENT of them go to all tasks as a table of bounded size; all others meet their scores in a join.

``base_score`` is the word-level model with add-half counts. Cases: a null or empty text is the end alone; a null
doc_id is a training row; without training rows counts are 0 and only ALPHA remains; repeated rows each count
and get a row; words may be of any length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.llm.common import cut, small_batches, space_words

ALPHA = 0.1
DISCOUNT = 0.75
FREQUENT = 1 << 17
SHORT = 64
HELD = 300_000
END = b""  # no word is empty


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Pieces of a byte-level vocabulary file with word ends: bytes without the end mark, and the
    slots 2 * i (inside a word) and 2 * i + 1 (closing one)."""

    MARK = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        self.number: dict[bytes, int] = {}
        self.of_id: dict[int, int] = {}
        for piece, i in sorted(vocab.items(), key=lambda x: x[1]):
            text = piece.removesuffix(self.MARK)
            if text and all(c in letters for c in text):
                raw = bytes(letters[c] for c in text)
                self.of_id[i] = self.number.setdefault(raw, len(self.number))
        for b in range(256):
            self.number.setdefault(bytes([b]), len(self.number))
        self.slots = 2 * len(self.number)


class Lattice:
    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray):
        p = (counts + ALPHA) / (counts.sum() + ALPHA * len(counts))
        log = np.log(p).tolist()
        self.inner = {w: log[2 * i] for w, i in vocabulary.number.items()}
        self.closing = {w: log[2 * i + 1] for w, i in vocabulary.number.items()}
        self.starts = {w[:n] for w in vocabulary.number for n in range(1, len(w) + 1)}

    def score(self, word: bytes) -> float:
        """log10 of the sum over all segmentations."""
        n = len(word)
        at: list[list[float]] = [[] for _ in range(n + 1)]
        at[0].append(0.0)
        inner, closing, starts, exp = self.inner, self.closing, self.starts, math.exp
        for i in range(n):
            came = at[i]
            at[i] = None
            if len(came) == 1:
                f = came[0]
            else:
                top = max(came)
                f = top + math.log(sum([exp(x - top) for x in came]))
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                if piece not in starts:
                    break
                lp = (closing if j == n else inner).get(piece)
                if lp is not None:
                    at[j].append(f + lp)
        came = at[n]
        top = max(came)
        return (top + math.log(sum([exp(x - top) for x in came]))) / math.log(10)


def word_counts(rows: DataFrame) -> DataFrame:
    """word, c: every word of rows (text, trains) and the end, with its count in training rows."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            words = list(seen)
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], names=["word", "c"]
                )
            seen.clear()

        for b in batches:
            for text, trains in zip(b.column("text").to_pylist(), b.column("trains").to_pylist(), strict=True):
                words = space_words(text)
                words.append(END)
                if trains:
                    seen.update(words)
                else:
                    for w in words:
                        if w not in seen:
                            seen[w] = 0
                if len(seen) > HELD:
                    yield from out()
        yield from out()

    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, tokenizer_path: str) -> np.ndarray:
    """Counts per slot, from the library's segmentation of each distinct training word."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok, vocabulary = Tokenizer.from_file(tokenizer_path), Vocabulary(tokenizer_path)
        total = np.zeros(vocabulary.slots)
        for b in batches:
            texts = [w.decode(errors="replace") for w in b.column("word").to_pylist()]
            for e in tok.encode_batch_fast(texts, add_special_tokens=False):
                ids = [vocabulary.of_id[i] for i in e.ids if i in vocabulary.of_id]
                for i in ids[:-1]:
                    total[2 * i] += 1
                if ids:
                    total[2 * ids[-1] + 1] += 1
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(total[kept])], names=["slot", "n"])

    rows = words.where("c > 0").select("word").mapInArrow(run, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(Vocabulary(tokenizer_path).slots)  # as many rows as the vocabulary has slots, at most
    if rows:
        out[[r.slot for r in rows]] = [r.n for r in rows]
    return out


def lattice_scores(docs: DataFrame, trains, tokenizer_path: str) -> DataFrame:
    """doc_id, trains, n_tokens, n_known, train_tokens, base_score, score, subword_score for every row of docs
    (doc_id, text); ``trains`` is the condition on a row under which the model learns from it."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(trains, F.lit(True)).alias("trains"))
    words = cut(word_counts(rows.select("text", "trains")), "words")
    total = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = total.n or 0, total.v or 0
    counts = piece_counts(words, tokenizer_path)
    model = spark.sparkContext.broadcast(counts)

    types = v - 1  # without the end

    def score(batches):
        lattice = Lattice(Vocabulary(tokenizer_path), model.value)
        for b in batches:
            sub, lp = [], []
            for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True):
                if w == END:
                    sub.append(math.log10(c / n) if c else math.log10(0.5))
                    lp.append(sub[-1])
                    continue
                sub.append(lattice.score(w))
                if not n or not types:
                    lp.append(sub[-1])
                elif c:
                    lp.append(math.log10((c - DISCOUNT + DISCOUNT * types * 10 ** sub[-1]) / n))
                else:
                    lp.append(math.log10(DISCOUNT * types / n) + sub[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column("word"), b.column("c"), pa.array(lp, pa.float64()), pa.array(sub, pa.float64())],
                names=["word", "c", "lp", "sub"],
            )

    scored = cut(words.mapInArrow(score, "word binary, c long, lp double, sub double"), "scored")

    # The table for all tasks: at most FREQUENT words of at most SHORT bytes.
    short = scored.where(F.length("word") <= SHORT)
    level = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    sizes = short.where("c > 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 64 rows at most
    least, held = None, 0
    for r in sizes:
        held += r["count"]
        if held > FREQUENT:
            break
        least = 2 ** r.level
    frequent = {}
    if least is not None:
        for r in short.where(F.col("c") >= least).collect():
            frequent[bytes(r.word)] = (r.c, r.lp, r.sub)
    denominator = n + 0.5 * (v + 1)
    table = spark.sparkContext.broadcast(
        {w: (math.log10((c + 0.5) / denominator), lp, sub) for w, (c, lp, sub) in frequent.items()}
    )

    def split(batches):
        known = table.value
        for b in batches:
            out = {x: [] for x in ("n_tokens", "known", "base", "score", "sub", "rare")}
            for text in b.column("text").to_pylist():
                seen = Counter(space_words(text))
                seen[END] += 1
                k, base, score, sub, rare = 0, 0.0, 0.0, 0.0, []
                for w, tf in seen.items():
                    got = known.get(w)
                    if got is None:
                        rare.append((w, tf))
                    else:
                        k += tf  # frequent words are training words
                        base += tf * got[0]
                        score += tf * got[1]
                        sub += tf * got[2]
                for name, x in zip(out, (sum(seen.values()), k, base, score, sub, rare), strict=True):
                    out[name].append(x)
            flat = [x for r in out["rare"] for x in r]
            offsets = np.cumsum([0, *map(len, out["rare"])])
            pairs = pa.StructArray.from_arrays(
                [pa.array([w for w, _ in flat], pa.binary()), pa.array([t for _, t in flat], pa.int64())], names=["word", "tf"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rid"), b.column("doc_id"), b.column("trains"),
                    pa.array(out["n_tokens"], pa.int64()), pa.array(out["known"], pa.int64()),
                    *(pa.array(out[x], pa.float64()) for x in ("base", "score", "sub")),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                ],
                names=["rid", "doc_id", "trains", "n_tokens", "known", "base", "score", "sub", "rare"],
            )

    kind = (
        "rid long, doc_id long, trains boolean, n_tokens long, known long, base double, score double, sub double,"
        " rare array<struct<word:binary,tf:long>>"
    )
    parts = cut(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(split, kind), "parts")
    met = (
        parts.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.tf")
        .join(scored, "word")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))).alias("more"),
            F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(denominator))).alias("b"),
            F.sum(F.col("tf") * F.col("lp")).alias("s"),
            F.sum(F.col("tf") * F.col("sub")).alias("p"),
        )
    )
    none = F.lit(0)
    return parts.drop("rare").join(met, "rid", "left").select(
        "doc_id", "trains", "n_tokens",
        (F.col("known") + F.coalesce("more", none)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
        (F.col("sub") + F.coalesce("p", F.lit(0.0))).alias("subword_score"),
    )
