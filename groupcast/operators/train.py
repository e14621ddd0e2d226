"""Grouped training of the linear forecaster.

Sequences come as blocks of a series' rows (operators/blocks.py); no window is stored. Predictions and
gradients are sums over the lags of products with the rows, computed per block in numpy and added up per owner by
Spark, so a hot owner's blocks are spread over tasks and combined map-side.

A local fit (all its epochs and mini-batches) is one job for all owners: an owner's blocks are dealt to shards of about
SHARD_SEQUENCES sequences, each shard meets its owner's parameters in a cogrouped map, trains on its own with Adam,
and the shards' results are averaged by their number of sequences. An owner with one shard, whatever the number of
owners, is trained exactly as alone; a larger one as the average of its shards (its rows fit no single task).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupcast.constants import EPS, HUBER_DELTA, LEARNING_RATE, SMAPE_WEIGHT
from groupcast.operators.blocks import arrays, lagged_scores, lagged_sums, shards, train_counts, window_view
from groupcast.operators.params import average_params
from groupcast.operators.scale import inverse_scale, scaler_center_scale
from groupcast.session import settle

OWNER = "client_id"
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8
BATCH_SIZE = 1024
SHARD_SEQUENCES = 1 << 18


def with_params(blocks: DataFrame, params: DataFrame, y_stats: DataFrame | None) -> DataFrame:
    """Blocks with their owner's body, a, b, y_center and y_scale (0 and 1 without y_stats)."""
    j = blocks.join(params.select(OWNER, "body", "a", "b"), OWNER)
    if y_stats is None:
        return j.withColumns({"y_center": F.lit(0.0), "y_scale": F.lit(1.0)})
    return j.join(y_stats.select(OWNER, "y_center", "y_scale"), OWNER)


def predict(blocks: DataFrame, params: DataFrame, y_stats: DataFrame | None = None) -> DataFrame:
    """K2: score every sequence with its owner's parameters. One row per sequence: the blocks'
    keys, is_fallback (if there), target_date, y, score, p_scaled and, with y_stats, y_center / y_scale."""
    keep = [c for c in blocks.columns if c not in ("block", "n", "width", "x", "y", "y_before", "target_date")]
    stats = ["y_center", "y_scale"] if y_stats is not None else []
    rows = with_params(blocks, params, y_stats).select(*keep, *stats, "width", "x", "y", "target_date", "body", "a", "b")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y, body = arrays(b.column("x")), b.column("y"), arrays(b.column("body"))
            width = b.column("width").to_numpy()
            scores = [lagged_scores(*z) for z in zip(x, width.tolist(), body, strict=True)]
            n = np.fromiter(map(len, scores), np.int64, len(scores))
            block = np.repeat(np.arange(b.num_rows), n)
            score = np.concatenate(scores)
            p = b.column("a").to_numpy()[block] * score + b.column("b").to_numpy()[block]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(block)) for c in (*keep, *stats)), b.column("target_date").flatten(), y.flatten(), pa.array(score), pa.array(p)],
                names=[*keep, *stats, "target_date", "y", "score", "p_scaled"],
            )

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*keep, *stats)), "target_date date, y double, score double, p_scaled double"])
    return rows.mapInArrow(run, schema)


def residual_grad(p: np.ndarray, y: np.ndarray, center: float, scale: float, delta: float, smape_weight: float) -> np.ndarray:
    """dLoss/dp per sequence (before the 1/N of the mean): Huber' + w * dSMAPE/dp,
    SMAPE taken on unscaled values (scale floored at 1e-8)."""
    grad = np.clip(p - y, -delta, delta)
    if smape_weight > 0:
        s = max(scale, EPS)
        pu, tu = p * s + center, y * s + center
        den = np.abs(tu) + np.abs(pu) + EPS
        grad = grad + smape_weight * 2.0 * (np.sign(pu - tu) * den - np.abs(pu - tu) * np.sign(pu)) / (den * den) * s
    return grad


def gradients(blocks: DataFrame, params: DataFrame, y_stats: DataFrame, delta: float = HUBER_DELTA,
              smape_weight: float = SMAPE_WEIGHT) -> DataFrame:
    """K3: per owner mean gradient of the loss: g_body, g_a, g_b, n."""
    rows = with_params(blocks, params, y_stats).select(OWNER, "n", "width", "x", "y", "body", "a", "b", "y_center", "y_scale")

    def run(batches):
        for b in batches:
            out = []
            more = zip(*(b.column(c).to_pylist() for c in ("width", "a", "b", "y_center", "y_scale")), strict=True)
            for x, y, body, (width, a, c, center, scale) in zip(arrays(b.column("x")), arrays(b.column("y")), arrays(b.column("body")), more, strict=True):
                score = lagged_scores(x, width, body)
                g = residual_grad(a * score + c, y, center, scale, delta, smape_weight)
                out.append(np.concatenate([lagged_sums(x, width, len(body) // width, g * a), [g @ score, g.sum()]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(OWNER), b.column("n").cast(pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=[OWNER, "n", "sums"])

    sums = rows.mapInArrow(run, f"{OWNER} string, n long, sums array<double>")
    agg = sums.groupBy(OWNER).agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("_s"), F.sum("n").cast("long").alias("n"))
    mean = agg.select(OWNER, "n", F.transform(F.arrays_zip(F.col("_s").alias("s"), F.array_repeat("n", F.size("_s")).alias("n")),
                                              lambda z: z["s"] / z["n"]).alias("_m"), (F.size("_s") - 2).alias("_d"))
    return mean.select(OWNER, F.slice("_m", 1, F.col("_d")).alias("g_body"), F.col("_m")[F.col("_d")].alias("g_a"),
                       F.col("_m")[F.col("_d") + 1].alias("g_b"), "n")


def gradient_step(blocks: DataFrame, params: DataFrame, y_stats: DataFrame, lr: float = LEARNING_RATE) -> DataFrame:
    """K3 as one plain descent step: theta - lr * grad."""
    g = gradients(blocks, params, y_stats)
    j = params.join(g, OWNER)
    return j.select(
        OWNER,
        F.zip_with("body", "g_body", lambda w, d: w - d * lr).alias("body"),
        (F.col("a") - F.lit(lr) * F.col("g_a")).alias("a"),
        (F.col("b") - F.lit(lr) * F.col("g_b")).alias("b"),
        "n",
    )


# ------------------------------------------------------------------ local fits
def epoch_batches(n: int, batch_size: int | None, seed: int, owner: str, shard: int, epoch: int) -> list[np.ndarray]:
    """The epoch's mini-batches as places of sequences: all in a new order, cut every ``batch_size``
    (None: one batch of all). The order depends on seed, owner, shard and epoch alone."""
    if not batch_size or batch_size >= n:
        return [np.arange(n)]
    order = np.random.default_rng([seed, zlib.crc32(owner.encode()), shard, epoch]).permutation(n)
    return [order[at : at + batch_size] for at in range(0, n, batch_size)]


class Adam:
    """Adam over one parameter vector, fresh moments."""

    def __init__(self, size: int, lr: float):
        self.m, self.v, self.t, self.lr = np.zeros(size), np.zeros(size), 0, lr

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = BETA1 * self.m + (1 - BETA1) * grad
        self.v = BETA2 * self.v + (1 - BETA2) * grad * grad
        m, v = self.m / (1 - BETA1**self.t), self.v / (1 - BETA2**self.t)
        return theta - self.lr * m / (np.sqrt(v) + ADAM_EPS)


def fit_shard(blocks: list[tuple[np.ndarray, np.ndarray]], width: int, theta: np.ndarray, center: float, scale: float, epochs: int,
              head_only: bool, lr: float, batch_size: int | None, seed: int, owner: str, shard: int,
              delta: float = HUBER_DELTA, smape_weight: float = SMAPE_WEIGHT) -> np.ndarray:
    """All epochs of one shard. ``blocks`` are (x, y) in order; theta = body, a, b. A batch's windows are gathered
    from the rows when its step is taken."""
    dim = len(theta) - 2
    y = np.concatenate([b for _, b in blocks])
    x = np.concatenate([a for a, _ in blocks])
    rows = np.concatenate([[0], np.cumsum([len(a) // width for a, _ in blocks])])
    place = np.concatenate([first + np.arange(len(b)) for first, (_, b) in zip(rows, blocks, strict=False)])
    window = window_view(x, width, dim)
    score = np.concatenate([lagged_scores(a, width, theta[:dim]) for a, _ in blocks]) if head_only else None
    adam = Adam(2 if head_only else len(theta), lr)
    for epoch in range(1, epochs + 1):
        for batch in epoch_batches(len(y), batch_size, seed, owner, shard, epoch):
            w = None if head_only else window[place[batch]]
            s = score[batch] if head_only else w @ theta[:dim]
            g = residual_grad(theta[dim] * s + theta[dim + 1], y[batch], center, scale, delta, smape_weight) / len(batch)
            head = np.array([g @ s, g.sum()])
            if head_only:
                theta = np.concatenate([theta[:dim], adam.step(theta[dim:], head)])
            else:
                theta = adam.step(theta, np.concatenate([theta[dim] * (g @ w), head]))
    return theta


def fit(train: DataFrame, params: DataFrame, y_stats: DataFrame, epochs: int, trainable: str = "all",
        lr: float = LEARNING_RATE, batch_size: int | None = BATCH_SIZE, seed: int = 42,
        counts: DataFrame | None = None, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """K4 / K5 / K6 (+ E7): Adam (fresh optimiser state per call) for every owner in ``params`` at once, all epochs
    and mini-batches in one job; ``trainable`` is 'all' or 'head'. Returns params (+ n = train sequences of
    the owner). ``batch_size=None``: one full-batch step per epoch. ``counts`` (client_id, n) saves counting ``train``."""
    mine = train.join(params.select(OWNER), OWNER, "left_semi")
    counts = train_counts(mine) if counts is None else counts.join(params.select(OWNER), OWNER, "left_semi")
    dealt, all_shards = shards(mine, counts, per_shard)
    left = dealt.select(OWNER, "shard", "item_id", "split", "block", "width", "x", "y")
    start = params.select(OWNER, "body", "a", "b").join(y_stats.select(OWNER, "y_center", "y_scale"), OWNER).join(all_shards, OWNER)
    right = start.select(F.col(OWNER).alias("_owner"), F.col("shard").alias("_shard"), "body", "a", "b", "y_center", "y_scale")
    head_only = trainable == "head"

    def run(key, data, own):
        owner, shard = key[0].as_py(), key[1].as_py()
        if not own.num_rows:
            return pa.table({OWNER: pa.array([], pa.string()), "n": pa.array([], pa.int64()), "body": pa.array([], pa.list_(pa.float64())),
                             "a": pa.array([], pa.float64()), "b": pa.array([], pa.float64())})
        theta = np.concatenate([arrays(own.column("body"))[0], [own.column("a")[0].as_py(), own.column("b")[0].as_py()]])
        n = 0
        if data.num_rows and epochs:
            data = data.sort_by([("item_id", "ascending"), ("split", "ascending"), ("block", "ascending")])
            parts = list(zip(arrays(data.column("x")), arrays(data.column("y")), strict=True))
            n = sum(len(y) for _, y in parts)
            theta = fit_shard(parts, data.column("width")[0].as_py(), theta, own.column("y_center")[0].as_py(), own.column("y_scale")[0].as_py(),
                              epochs, head_only, lr, batch_size, seed, owner, shard)
        elif data.num_rows:
            n = sum(map(len, arrays(data.column("y"))))
        return pa.table({OWNER: [owner], "n": pa.array([n], pa.int64()), "body": pa.array([theta[:-2]], pa.list_(pa.float64())),
                         "a": [theta[-2]], "b": [theta[-1]]})

    fitted = left.groupBy(OWNER, "shard").cogroup(right.groupBy("_owner", "_shard")).applyInArrow(
        run, f"{OWNER} string, n long, body array<double>, a double, b double")
    # A shard without blocks weighs nothing; an owner without any keeps its start.
    done = average_params(settle(fitted).filter("n > 0"), OWNER, "n")
    new = done.select(OWNER, F.col("body").alias("_body"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_n"))
    keep = [c for c in params.columns if c not in ("body", "a", "b", "n", OWNER)]
    return params.join(new, OWNER, "left").select(
        OWNER, F.coalesce("_body", "body").alias("body"), F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"),
        *keep, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


# ------------------------------------------------------------------ evaluation
def evaluate(eval_blocks: DataFrame, params: DataFrame, y_stats: DataFrame, naive: DataFrame | None = None,
             delta: float = HUBER_DELTA, smape_weight: float = SMAPE_WEIGHT) -> DataFrame:
    """Loss and the five metrics per owner on its eval sequences, in one
    grouped aggregate over the predictions (computed once)."""
    pr = predict(eval_blocks, params, y_stats)
    center, s = scaler_center_scale(F.col("y_center"), F.col("y_scale"))
    yp = inverse_scale(F.col("p_scaled"), center, s)
    yt = inverse_scale(F.col("y"), center, s)
    e = F.col("p_scaled") - F.col("y")
    ae = F.abs(e)
    huber = F.when(ae <= delta, F.lit(0.5) * e * e).otherwise(F.lit(delta) * (ae - F.lit(0.5 * delta)))
    sm = F.lit(2.0) * F.abs(yp - yt) / (F.abs(yt) + F.abs(yp) + F.lit(EPS))
    err = yp - yt
    agg = pr.groupBy(OWNER).agg(
        F.count(F.lit(1)).cast("long").alias("num_samples"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(100.0) * F.avg(sm)).alias("smape"),
        (F.sum(F.abs(err)) / (F.sum(F.abs(yt)) + F.lit(EPS))).alias("wmape"),
        (F.avg(huber) + (F.lit(smape_weight) * F.avg(sm) if smape_weight > 0 else F.lit(0.0))).alias("loss"),
    )
    if naive is None:
        return agg.withColumn("mase", F.lit(None).cast("double"))
    return agg.join(naive, OWNER, "left").withColumn(
        "mase", F.col("mae") / F.coalesce(F.col("naive_mae"), F.lit(EPS))).drop("naive_mae")


def naive_from_train(train: DataFrame, y_stats: DataFrame) -> DataFrame:
    """L6 on the unscaled train targets of every owner: mean |y_t - y_(t-1)| over its targets in (item, date) order.
    Differences are scaled ones times the scale, taken per block; blocks and items join at their ends."""
    scaled = train.join(y_stats.select(OWNER, F.greatest("y_scale", F.lit(EPS)).alias("_s")), OWNER)
    first, last = F.element_at("y", 1), F.element_at("y", -1)
    within = F.aggregate(F.zip_with(F.slice("y", 2, F.size("y") - 1), F.slice("y", 1, F.size("y") - 1), lambda p, q: F.abs(p - q)),
                         F.lit(0.0), lambda acc, v: acc + v)
    # The first block of an item follows the item before.
    order = Window.partitionBy(OWNER).orderBy("item_id")
    items = scaled.groupBy(OWNER, "item_id").agg(
        F.sum(within + F.coalesce(F.abs(first - F.col("y_before")), F.lit(0.0))).alias("s"), F.sum("n").alias("n"),
        F.min_by(first, "block").alias("first"), F.max_by(last, "block").alias("last"), F.max("_s").alias("_s"))
    jump = F.coalesce(F.abs(F.col("first") - F.lag("last").over(order)), F.lit(0.0))
    per = items.select(OWNER, "s", "n", "_s", jump.alias("j")).groupBy(OWNER).agg(
        ((F.sum("s") + F.sum("j")) * F.max("_s")).alias("abs_diff"), F.sum("n").alias("n"))
    nm = F.when(F.col("n") > 1, F.greatest(F.col("abs_diff") / (F.col("n") - 1).cast("double"), F.lit(EPS))).otherwise(F.lit(EPS))
    return per.select(OWNER, nm.alias("naive_mae"))
