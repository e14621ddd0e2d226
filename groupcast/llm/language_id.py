"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lowered (A-Z), cut into words at everything that is neither a letter,
a digit nor a non-ASCII character, and the words are joined by one space. Its
features are all 2-, 3- and 4-byte pieces, hashed into BUCKETS. The model
averages their embeddings and applies a linear softmax; both are learned
together by stochastic gradient descent in numpy on a bounded sample of labelled
rows (SAMPLE_ROWS in all, equally many per language, the lowest hashes of
doc_id). A fifth of the sample is kept out of training: on it the softmax
temperature is fitted and the rejection threshold is set to the REJECT_SHARE
quantile of the confidence, at most REJECT_MOST, so that short and mixed texts stay.

Cases: a null or letterless text (empty included) gets ``und`` and score 0; null
languages are not learned from; a null doc_id counts as a training row; without
any labelled row every text is ``und``; repeated rows each get a row; other
columns are ignored. Texts are read whole, in pieces of 1 MB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from groupcast.llm.common import LOWER_WORDS, cut, free_name, small_batches

BUCKETS = 1 << 15
DIM = 16
EPOCHS = 6
RATE = 0.5
SAMPLE_ROWS = 2000
REJECT_SHARE = 0.001
REJECT_MOST = 0.35
PIECE = 1 << 20


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels: embedding times softmax weights, divided by the temperature
    bias: np.ndarray
    reject_below: float


def parts_of(model: Model | None) -> tuple | None:
    """Plain values, which a worker can read without this package on its path."""
    return None if model is None else (model.labels, model.weights, model.bias, model.reject_below)


def feature_ids(text: str):
    """Bucket numbers of the text's pieces, in parts of about PIECE bytes."""
    raw = b" " + b" ".join(text.encode().translate(LOWER_WORDS).split()) + b" "
    for at in range(0, len(raw) - 1, PIECE):
        a = np.frombuffer(raw[at : at + PIECE + 3], dtype=np.uint8).astype(np.uint32)
        h = a
        for n in (2, 3, 4):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ (a[n - 1 :] * np.uint32(0x85EBCA6B))
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield mixed >> np.uint32(17)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for ids in feature_ids(text):
        total += np.bincount(ids, minlength=BUCKETS)
    kept = np.flatnonzero(total)
    return kept.astype(np.uint16), (total[kept] / max(1, total.sum())).astype(np.float32)


def train(rows: list[tuple[str, np.ndarray, np.ndarray, bool]], seed: int = 7) -> Model | None:
    """rows: (label, buckets, shares, kept out for calibration)."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(labels)}
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    fit = [r for r in rows if not r[3]] or rows
    # Shares of common pieces are small: RATE is scaled so that a step moves a logit noticeably.
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            label, ids, share, _ = fit[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[label]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            emb[ids] -= 40 * rate * np.outer(share, back)
    weights = emb @ out
    held = [r for r in rows if r[3]] or rows
    logits = np.array([share @ weights[ids] + bias for _, ids, share, _ in held])
    truth = np.array([number[r[0]] for r in held])

    def soft(t):
        z = logits / t
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def loss(t):
        return -np.log(soft(t)[np.arange(len(truth)), truth] + 1e-12).mean()

    best = min(np.geomspace(0.25, 8, 41), key=loss)
    threshold = min(REJECT_MOST, float(np.quantile(soft(best).max(axis=1), REJECT_SHARE)))
    return Model(labels, (weights / best).astype(np.float32), (bias / best).astype(np.float32), threshold)


def predict(model: Model, text: str) -> tuple[str, float]:
    total, n = np.zeros(len(model.labels)), 0
    for ids in feature_ids(text):
        total += model.weights[ids].sum(axis=0, dtype=np.float64)
        n += len(ids)
    z = total / max(1, n) + model.bias
    e = np.exp(z - z.max())
    best = int(np.argmax(e))
    return model.labels[best], float(e[best] / e.sum())


def has_letter(text):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, trains) -> Model | None:
    """Fit on labelled rows of docs (doc_id, text, lang) for which ``trains`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(trains & F.col("lang").isNotNull() & has_letter("text")).select("doc_id", "text", "lang")
    sizes = docs.where(trains & F.col("lang").isNotNull()).groupBy("lang").count()
    spread = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000_007)) / 1_000_000_007.0
    each = F.greatest(F.lit(1), F.floor(F.lit(SAMPLE_ROWS) / F.count("*").over(W.partitionBy(F.lit(1)))))
    # One row per language, written first: its size is known when the join is planned.
    quota = cut(sizes.select("lang", "count", each.alias("each")), "quota")
    near = (
        rows.withColumn("u", spread)
        .join(quota, "lang")
        .where(F.col("u") * F.col("count") <= 3 * F.col("each") + 20)
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("u", "doc_id", "text")))
        .where("rank <= each")
        .select("lang", "text", (F.col("rank") % 5 == 0).alias("held"))
    )

    def bags(batches):
        for b in batches:
            made = [bag(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("lang"),
                    b.column("held"),
                    pa.array([i.tobytes() for i, _ in made], pa.binary()),
                    pa.array([s.tobytes() for _, s in made], pa.binary()),
                ],
                names=["lang", "held", "ids", "shares"],
            )

    # At most SAMPLE_ROWS rows of at most BUCKETS entries reach the driver.
    got = near.mapInArrow(bags, "lang string, held boolean, ids binary, shares binary").collect()
    got = sorted(got, key=lambda r: (r.lang, bytes(r.ids), bytes(r.shares)))
    return train(
        [(r.lang, np.frombuffer(r.ids, np.uint16), np.frombuffer(r.shares, np.float32), r.held) for r in got]
    )


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(parts_of(model))

    def run(batches):
        m = Model(*shared.value) if shared.value else None
        for b in batches:
            said = [
                predict(m, t) if ok and m else ("und", 0.0)
                for t, ok in zip(b.column("text").to_pylist(), b.column("ok").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([x for x, _ in said], pa.string()),
                    pa.array([s for _, s in said], pa.float64()),
                    pa.array([x == "und" or s < m.reject_below for x, s in said], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter("text").alias("ok"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows that the model rejects; the same columns."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(parts_of(model))
    names, letters = docs.columns, free_name(docs, "ok")

    def run(batches):
        m = Model(*shared.value) if shared.value else None
        for b in batches:
            ok = [
                bool(o and m) and predict(m, t)[1] >= m.reject_below
                for t, o in zip(b.column("text").to_pylist(), b.column(letters).to_pylist(), strict=True)
            ]
            yield b.select(names).filter(pa.array(ok, pa.bool_()))

    return docs.withColumn(letters, has_letter("text")).mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id", remainder: int = 0):
    """crc32 of the id as text leaves this remainder at division by 5 (null: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == remainder, F.lit(False))
