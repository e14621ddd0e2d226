"""Blocks of series, and training on them, against windows written out one by one."""

import datetime as dt
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupcast.operators import blocks as bl
from groupcast.operators import train as tr

L, WIDTH = 3, 2
DAY = dt.date(2021, 1, 1)


def series(seed=1):
    """(client, item, split, date, f0, f1, y) of runs around the interesting lengths."""
    rng = np.random.default_rng(seed)
    out = []
    for client, item, lengths in [("a", "i", (40, 5, 9)), ("a", "j", (3, 4, 2)), ("a", "k", (11, 0, 0)), ("b", "i", (4, 20, 0)), ("c", "i", (2, 1, 0))]:
        day = 0
        for split, n in zip(("train", "val", "test"), lengths, strict=True):
            for _ in range(n):
                out.append((client, item, split, DAY + dt.timedelta(days=day), *map(float, rng.normal(size=3))))
                day += 1
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "client_id string, item_id string, split string, date date, f0 double, f1 double, y double")
    return df.repartition(3)


def sequences(rows):
    """(client, item, split) -> [(date, flattened window, y, y before or None)]"""
    runs = {}
    for r in sorted(rows):
        runs.setdefault(r[:3], []).append(r)
    runs = {k: sorted(v, key=lambda r: r[3]) for k, v in runs.items()}
    return {k: [(v[t][3], [f for r in v[t - L : t] for f in r[4:6]], v[t][6], v[t - 1][6] if t > L else None) for t in range(L, len(v))]
            for k, v in runs.items()}


@pytest.mark.parametrize(("targets", "batch"), [(512, 10_000), (4, 10_000), (4, 7), (1, 1)])
def test_blocks_hold_every_sequence_once(spark, targets, batch):
    rows = series()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        made = bl.series_blocks(frame(spark, rows), ["f0", "f1"], "y", L, targets=targets)
        got = made.collect()
        wide = {(r.client_id, r.item_id, r.split, r.target_date): (r.x, r.y) for r in bl.windows(made, L * WIDTH).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = sequences(rows)
    assert wide == {(*k, d): (x, y) for k, v in want.items() for d, x, y, _ in v}
    seen = {}
    for r in sorted(got, key=lambda r: r.block):
        assert 0 < r.n <= targets and len(r.x) == (r.n + L - 1) * WIDTH and r.width == WIDTH
        mine = seen.setdefault((r.client_id, r.item_id, r.split), [])
        assert r.block * targets == len(mine)
        for k in range(r.n):
            mine.append((r.target_date[k], r.x[k * WIDTH : (k + L) * WIDTH], r.y[k], r.y[k - 1] if k else r.y_before))
    assert seen == {k: [(d, x, y, p if n else None) for n, (d, x, y, p) in enumerate(v)] for k, v in want.items() if v}


def sets(spark, rows, targets=4):
    df = frame(spark, rows)
    made = bl.series_blocks(df, ["f0", "f1"], "y", L, targets=targets)
    return bl.training_blocks(made, df.select("client_id").distinct(), WIDTH, L)


def test_fallbacks(spark):
    train, ev = sets(spark, series())
    zero = [0.0] * (L * WIDTH)
    got = {(r.client_id, r.split, r.is_fallback): (r.n, r.x, r.y) for r in train.filter("is_fallback").unionByName(ev.filter("is_fallback")).collect()}
    assert got == {("c", "train", True): (1, zero, [0.0]), ("c", "test", True): (1, zero, [0.0])}
    assert {(r.client_id, r.split) for r in ev.collect()} == {("a", "test"), ("b", "val"), ("c", "test")}
    assert {r.client_id: r.n for r in bl.train_counts(train).collect()} == {"a": 37 + 1 * 0 + 8, "b": 1, "c": 1}


def loss_grad(p, y, center, scale):
    s = max(scale, 1e-8)
    g = np.clip(p - y, -1.0, 1.0)
    pu, tu = p * s + center, y * s + center
    den = abs(tu) + abs(pu) + 1e-8
    return g + 0.1 * s * 2 * (np.sign(pu - tu) * den - abs(pu - tu) * np.sign(pu)) / den**2


def brute_fit(X, y, body, a, b, center, scale, epochs, lr, batch, seed, owner, head_only=False, shard=0):
    """Adam over mini-batches, sequence by sequence."""
    theta = np.array([*body, a, b])
    m, v, t = np.zeros_like(theta), np.zeros_like(theta), 0
    for e in range(1, epochs + 1):
        order = np.arange(len(y)) if not batch or batch >= len(y) else np.random.default_rng([seed, zlib.crc32(owner.encode()), shard, e]).permutation(len(y))
        for at in range(0, len(y), batch or len(y)):
            part = order[at : at + (batch or len(y))]
            grad = np.zeros_like(theta)
            for i in part:
                s = float(np.dot(theta[:-2], X[i]))
                g = loss_grad(theta[-2] * s + theta[-1], y[i], center, scale) / len(part)
                grad += np.array([*(g * theta[-2] * np.array(X[i])), g * s, g])
            if head_only:
                grad[:-2] = 0
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def inputs(spark):
    rows = series()
    train, _ = sets(spark, rows)
    params = [("a", [0.1, -0.2, 0.3, 0.0, 0.2, -0.1], 1.2, 0.1), ("b", [0.0, 0.1, 0.2, 0.3, -0.4, 0.5], 0.7, -0.3), ("c", [0.3] * 6, 1.0, 0.5)]
    stats = [("a", 10.0, 2.0), ("b", -1.0, 0.5), ("c", 0.0, 1.0)]
    P = spark.createDataFrame(params, "client_id string, body array<double>, a double, b double")
    S = spark.createDataFrame(stats, "client_id string, y_center double, y_scale double")
    mine = {}
    for (client, _, split), seqs in sorted(sequences(rows).items()):
        if split == "train":
            mine.setdefault(client, []).extend((x, y) for _, x, y, _ in seqs)
    mine["c"] = [([0.0] * 6, 0.0)]
    return train, P, S, params, stats, mine


@pytest.mark.parametrize(("kind", "batch"), [("all", 8), ("all", None), ("head", 8), ("all", 1024)])
def test_fit_equals_brute_force(spark, kind, batch):
    train, P, S, params, stats, mine = inputs(spark)
    got = {r.client_id: r for r in tr.fit(train, P, S, 3, kind, 0.01, batch, seed=5).collect()}
    for (c, body, a, b), (_, center, scale) in zip(params, stats, strict=True):
        X, y = [x for x, _ in mine[c]], [t for _, t in mine[c]]
        want = brute_fit(X, y, body, a, b, center, scale, 3, 0.01, batch, 5, c, kind == "head")
        assert [*got[c].body, got[c].a, got[c].b] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-12)
        assert got[c].n == len(y)


def test_fit_of_shards_is_their_weighted_mean(spark):
    train, P, S, params, stats, _ = inputs(spark)
    got = {r.client_id: r for r in tr.fit(train, P, S, 2, "all", 0.01, 8, seed=5, per_shard=10).collect()}
    dealt, _ = bl.shards(train, bl.train_counts(train), 10)
    rows = sorted(dealt.filter("client_id = 'a'").collect(), key=lambda r: (r.item_id, r.split, r.block))
    assert len({r.shard for r in rows}) > 1
    _, body, a, b = params[0]
    total, weight = 0, 0
    for shard in {r.shard for r in rows}:
        seqs = [(r.x[k * WIDTH : (k + L) * WIDTH], r.y[k]) for r in rows if r.shard == shard for k in range(r.n)]
        theta = brute_fit([x for x, _ in seqs], [y for _, y in seqs], body, a, b, 10.0, 2.0, 2, 0.01, 8, 5, "a", shard=shard)
        total, weight = total + len(seqs) * theta, weight + len(seqs)
    assert [*got["a"].body, got["a"].a, got["a"].b] == pytest.approx((total / weight).tolist(), rel=1e-9)
    assert got["a"].n == weight


def test_a_fit_is_one_job_of_few(spark):
    train, P, S, *_ = inputs(spark)
    from groupcast.session import settle

    train, counts = settle(train), settle(bl.train_counts(train))
    sc = spark.sparkContext
    sc.setJobGroup("one-fit", "one fit")
    tr.fit(train, P, S, 3, "all", 0.01, 8, counts=counts)
    ids = sc.statusTracker().getJobIdsForGroup("one-fit")
    sc.setLocalProperty("spark.jobGroup.id", None)
    # Adaptive execution runs each shuffle's map side and each broadcast as a job of its own; none depends on epochs or batches.
    few = len(ids)
    sc.setJobGroup("more-epochs", "more epochs")
    tr.fit(train, P, S, 9, "all", 0.01, 4, counts=counts)
    more = len(sc.statusTracker().getJobIdsForGroup("more-epochs"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert more == few


def test_gradient_and_naive_error(spark):
    train, P, S, params, stats, mine = inputs(spark)
    got = {r.client_id: r for r in tr.gradients(train, P, S).collect()}
    for (c, body, a, b), (_, center, scale) in zip(params, stats, strict=True):
        X, y = np.array([x for x, _ in mine[c]]), np.array([t for _, t in mine[c]])
        s = X @ np.array(body)
        g = loss_grad(a * s + b, y, center, scale)
        assert got[c].g_body == pytest.approx(((g * a) @ X / len(y)).tolist(), rel=1e-9, abs=1e-12)
        assert (got[c].g_a, got[c].g_b) == pytest.approx((float(g @ s) / len(y), float(g.mean())), rel=1e-9, abs=1e-12)
    naive = {r.client_id: r.naive_mae for r in tr.naive_from_train(train, S).collect()}
    for (c, _, scale) in stats:
        y = np.array([t for _, t in mine[c]]) * scale
        assert naive[c] == pytest.approx(max(np.abs(np.diff(y)).mean(), 1e-8) if len(y) > 1 else 1e-8, rel=1e-9)


def test_sequence_moments_equal_row_moments(spark):
    from groupcast.operators.profiles import row_moments, sequence_moments

    train, *_ = sets(spark, series())
    wide = bl.windows(train.drop("is_fallback"), L * WIDTH)
    a = {r.client_id: r for r in sequence_moments(train, L).collect()}
    b = {r.client_id: r for r in row_moments(wide).collect()}
    for c in ("a", "b", "c"):
        assert a[c].d == b[c].d and a[c].m == pytest.approx(b[c].m, rel=1e-9, abs=1e-12)


def test_ungrouped_runs(spark):
    df = frame(spark, series()).filter(F.col("client_id") == "a")
    whole = bl.series_blocks(df, ["f0"], "y", L, keys=["client_id"], targets=5)
    assert whole.agg(F.sum("n")).first()[0] == df.count() - L


def brute_trees(X, rows, y, trees, depth, bins, rate=0.3, lam=1.0):
    """Boosted trees by trying every cut of every position on the sequences themselves."""
    edges = [np.unique([sorted(col)[int((k / bins) * (len(col) - 1))] for k in range(1, bins)]) for col in rows.T]
    gain, count, margin = np.zeros(X.shape[1]), np.zeros(X.shape[1]), np.full(len(y), y.mean())

    def grow(seqs, d, grad):
        best = (1e-9, None, None)
        G, n = grad[seqs].sum(), len(seqs)
        if d < depth and n > 1:
            for pos in range(X.shape[1]):
                for e in edges[pos % rows.shape[1]]:
                    left = [i for i in seqs if X[i, pos] < e]
                    if 0 < len(left) < n:
                        gl = grad[left].sum()
                        v = 0.5 * (gl**2 / (len(left) + lam) + (G - gl) ** 2 / (n - len(left) + lam) - G**2 / (n + lam))
                        if v > best[0] + 1e-12:
                            best = (v, pos, e)
        if best[1] is None:
            margin[seqs] -= rate * G / (n + lam)
            return
        gain[best[1]] += best[0]
        count[best[1]] += 1
        grow([i for i in seqs if X[i, best[1]] < best[2]], d + 1, grad)
        grow([i for i in seqs if X[i, best[1]] >= best[2]], d + 1, grad)

    for _ in range(trees):
        grow(list(range(len(y))), 0, margin - y)
    mean = np.divide(gain, count, out=np.zeros_like(gain), where=count > 0)
    return mean / mean.sum() if mean.sum() > 0 else mean


def test_tree_importance_equals_brute_force(spark):
    from groupcast.operators.profiles import importance_gbt

    data = series()
    train, *_ = sets(spark, data)
    got = {}
    for r in importance_gbt(train, seq_len=L, trees=4, depth=3, bins=8).collect():
        got.setdefault(r.client_id, {})[r.pos] = r.importance
    runs = {}
    for r in sorted(data):
        if r[2] == "train":
            runs.setdefault(r[:2], []).append(r)
    # A block holds the rows from its halo on; a client's bins come from the rows of all its blocks.
    rows = []
    for key in sorted(k for k in runs if k[0] == "a"):
        v = [r[4:6] for r in sorted(runs[key], key=lambda r: r[3])]
        for at in range(0, max(0, len(v) - L), 4):
            rows += v[at : at + min(4, len(v) - L - at) + L - 1]
    seqs = [s for k, v in sorted(sequences(data).items()) if k[0] == "a" and k[2] == "train" for s in v]
    X, y = np.array([s[1] for s in seqs]), np.array([s[2] for s in seqs])
    want = brute_trees(X, np.array(rows), y, 4, 3, 8)
    assert [got["a"][p] for p in range(L * WIDTH)] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-9)
    assert set(got["c"].values()) == {0.0}  # a zero sequence alone splits nothing


def test_trees_find_what_decides(spark):
    from groupcast.functions.boosting import split_gains

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400 + L - 1, WIDTH))
    y = np.where(x[1 : 401, 1] > 0.3, 4.0, -1.0) + 0.05 * rng.normal(size=400)  # the second row's second feature
    gain, count = split_gains([(x.ravel(), y)], WIDTH, L * WIDTH, trees=20)
    assert int(np.argmax(gain)) == 1 * WIDTH + 1 and gain[3] > 0.9 * gain.sum()
