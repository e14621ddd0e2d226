"""Hand fixtures for the DataFrame operators (FIXTURES.md section 5)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from groupcast.functions.arrays import array_cdf, array_l1, clip_l2, ema_combine, normalise_distribution


def _rows(spark, n, client="c", item="i"):
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame(
        [(client, item, start + dt.timedelta(days=k), float(k)) for k in range(n)], "client_id string, item_id string, date date, y double")


def _split_counts(spark, n):
    from groupcast.operators.split import chrono_split

    s = chrono_split(_rows(spark, n))
    got = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    return got.get("train", 0), got.get("val", 0), got.get("test", 0)


def test_split_20_rows(spark):
    assert _split_counts(spark, 20) == (14, 3, 3)


def test_split_one_row(spark):
    assert _split_counts(spark, 1) == (0, 0, 1)


def test_split_in_date_order(spark):
    from groupcast.operators.split import chrono_split

    rows = chrono_split(_rows(spark, 40)).orderBy("date").select("split").collect()
    order = {"train": 0, "val": 1, "test": 2}
    seq = [order[r.split] for r in rows]
    assert seq == sorted(seq)


@pytest.mark.parametrize("n,expected", [(16, 2), (14, 0), (15, 1)])
def test_sequence_count(spark, n, expected):
    from groupcast.operators.split import make_sequences

    df = _rows(spark, n).withColumn("split", F.lit("train"))
    seqs = make_sequences(df, ["y"], "y", 14)
    assert seqs.count() == expected


def test_sequence_never_crosses_items(spark):
    from groupcast.operators.split import make_sequences

    df = _rows(spark, 16, item="a").unionByName(_rows(spark, 10, item="b")).withColumn("split", F.lit("train"))
    seqs = make_sequences(df, ["y"], "y", 14).collect()
    assert len(seqs) == 2 and all(r.item_id == "a" for r in seqs)
    assert sorted(r.y for r in seqs) == [14.0, 15.0]
    assert [r.x for r in seqs if r.y == 14.0][0] == [float(k) for k in range(14)]


def test_array_helpers(spark):
    df = spark.createDataFrame([([-1.0, 3.0, 1.0], [-1.0, -2.0], [3.0, 4.0], [0.5, 0.5, 0.0], [0.0, 0.5, 0.5])],
                               "a array<double>, b array<double>, c array<double>, p array<double>, q array<double>")
    r = df.select(
        normalise_distribution("a").alias("na"), normalise_distribution("b").alias("nb"), clip_l2("c", 0.15).alias("cc"),
        array_l1(array_cdf("p"), array_cdf("q")).alias("emd"), array_cdf("a").alias("cdf"),
    ).first()
    assert r.na == pytest.approx([0.0, 0.75, 0.25])
    assert r.nb == pytest.approx([0.5, 0.5])
    assert r.cc == pytest.approx([0.09, 0.12])
    assert r.emd == pytest.approx(1.0)
    assert r.cdf == pytest.approx([-1.0, 2.0, 3.0])


def test_ema_fold(spark):
    out = []
    state = None
    for val in [1.0, 0.0, 0.0]:
        cur = spark.createDataFrame([("c", [val])], "client_id string, v array<double>")
        if state is None:
            state = cur.select("client_id", F.col("v").alias("s"))
        else:
            state = state.join(cur, "client_id").select("client_id", ema_combine("s", "v", 0.8).alias("s"))
        out.append(state.first().s[0])
    assert out == pytest.approx([1.0, 0.8, 0.64])


def test_ema_length_change_resets(spark):
    df = spark.createDataFrame([([1.0, 1.0], [0.0])], "o array<double>, n array<double>")
    assert df.select(ema_combine("o", "n", 0.8).alias("e")).first().e == [0.0]


def test_update_vector_split(spark):
    from groupcast.plans.strategies import update_vectors

    fitted = spark.createDataFrame([("c", [1.0, -2.0])], "client_id string, body array<double>")
    assign = spark.createDataFrame([("c", 0)], "client_id string, bubble int")
    common = spark.createDataFrame([(0, [0.0, 0.0])], "bubble int, body array<double>")
    assert update_vectors(fitted, assign, common).first().importance == [1.0, 0.0, 0.0, 2.0]


def test_weighted_average(spark):
    from groupcast.operators.params import average_params

    p = spark.createDataFrame([("x", [1.0], 1.0, 1.0, 1), ("y", [4.0], 4.0, 4.0, 2)],
                              "client_id string, body array<double>, a double, b double, n long").withColumn("bubble", F.lit(0))
    r = average_params(p, "bubble", "n").first()
    assert r.body == pytest.approx([3.0]) and r.a == pytest.approx(3.0) and r.n == 3


def test_average_of_equal_params_is_identity(spark):
    from groupcast.operators.params import average_params

    p = spark.createDataFrame([(c, [0.3, -0.7], 0.5, -0.1, n) for c, n in [("x", 3), ("y", 9), ("z", 1)]],
                              "client_id string, body array<double>, a double, b double, n long").withColumn("bubble", F.lit(0))
    r = average_params(p, "bubble", "n").first()
    assert r.body == pytest.approx([0.3, -0.7]) and r.a == pytest.approx(0.5) and r.b == pytest.approx(-0.1)


def test_robust_scale(spark):
    from groupcast.operators.scale import fit_robust

    df = spark.createDataFrame([("c", float(v), "train") for v in [1, 2, 3, 4]], "client_id string, y double, split string")
    r = fit_robust(df).first()
    assert r.y_center == pytest.approx(2.5) and r.y_scale == pytest.approx(1.5)


def test_standard_scale_constant_column(spark):
    from groupcast.operators.scale import fit_standard

    df = spark.createDataFrame([("c", 5.0, float(v), "train") for v in [1, 2, 3]], "client_id string, k double, v double, split string")
    r = fit_standard(df, ["k", "v"]).first()
    assert r.x_scale[0] == 1.0 and r.x_center[0] == 5.0
    assert r.x_scale[1] == pytest.approx((2.0 / 3.0) ** 0.5)


def test_constant_feature_f_and_p(spark):
    from groupcast.operators.select import add_pvalues, f_scores

    df = spark.createDataFrame([(1.0, float(v), float(2 * v + (v % 3))) for v in range(30)], "k double, x double, y double")
    r = {row.feature: row for row in add_pvalues(f_scores(df, ["k", "x"], "y")).collect()}
    assert r["k"].f_score == 0.0 and r["k"].p_value == 1.0
    assert r["x"].f_score > 100 and r["x"].p_value < 1e-10


def test_smape_zero_zero(spark):
    from groupcast.operators.metrics import client_metrics

    df = spark.createDataFrame([("c", 0.0, 0.0)], "client_id string, y_true double, y_pred double")
    assert client_metrics(df).first().smape == 0.0


def test_naive_mae_crosses_items(spark):
    from groupcast.operators.metrics import naive_mae

    d = dt.date(2020, 1, 1)
    rows = [("c", "a", d, 1.0), ("c", "a", d + dt.timedelta(1), 3.0), ("c", "b", d, 7.0)]
    df = spark.createDataFrame(rows, "client_id string, item_id string, target_date date, y_true double")
    # concatenated order a:1,3 then b:7 -> |3-1| + |7-3| = 6 over 2 diffs
    assert naive_mae(df).first().naive_mae == pytest.approx(3.0)
    one = spark.createDataFrame([rows[0]], "client_id string, item_id string, target_date date, y_true double")
    assert naive_mae(one).first().naive_mae == pytest.approx(1e-8)


def test_sample_per_client_matches_brute_force(spark):
    from groupcast.functions.columns import hash_uniform
    from groupcast.operators.split import sample_per_client

    df = spark.range(500).select(F.when(F.col("id") < 300, "hot").otherwise("cold").alias("client_id"), F.col("id").cast("string").alias("k"))
    got = sorted((r.client_id, r.k) for r in sample_per_client(df, 20, 7, ["k"], buckets=8).collect())
    scored = df.withColumn("u", hash_uniform("k", seed=7)).collect()
    want = []
    for c in ("hot", "cold"):
        rows = sorted([r for r in scored if r.client_id == c], key=lambda r: (r.u, r.k))[:20]
        want += [(c, r.k) for r in rows]
    assert got == sorted(want)


def _as_blocks(spark, rows):
    """Single sequences (client, item, window, target) as blocks of one target each."""
    return spark.createDataFrame(
        [(c, i, "train", k, 1, len(x), x, [y], None, [dt.date(2020, 1, 1) + dt.timedelta(days=k)]) for k, (c, i, x, y) in enumerate(rows)],
        "client_id string, item_id string, split string, block int, n int, width int, x array<double>, y array<double>, "
        "y_before double, target_date array<date>")


def test_predict_matches_numpy(spark):
    from groupcast.operators.train import predict

    seqs = _as_blocks(spark, [("c", "i", [1.0, 2.0, 3.0], 0.0)])
    params = spark.createDataFrame([("c", [0.5, -1.0, 2.0], 2.0, 0.25)], "client_id string, body array<double>, a double, b double")
    r = predict(seqs, params).first()
    assert r.score == pytest.approx(4.5) and r.p_scaled == pytest.approx(9.25)


def test_evaluate_agrees_with_separate_operators(spark):
    from groupcast.operators.metrics import client_metrics, huber_smape_loss
    from groupcast.operators.train import evaluate, predict

    rng = np.random.default_rng(4)
    seqs = _as_blocks(
        spark, [(c, "i", [float(v) for v in rng.normal(0, 1, 3)], float(rng.normal(0, 2))) for c in ("a", "b") for _ in range(25)])
    params = spark.createDataFrame([("a", [0.2, -0.1, 0.4], 1.5, 0.1), ("b", [0.0, 0.3, -0.2], 0.7, -0.3)],
                                   "client_id string, body array<double>, a double, b double")
    ys = spark.createDataFrame([("a", 10.0, 2.0), ("b", -1.0, 0.5)], "client_id string, y_center double, y_scale double")
    ev = {r.client_id: r for r in evaluate(seqs, params, ys).collect()}
    pr = predict(seqs, params, ys)
    un = pr.withColumn("y_pred", F.col("p_scaled") * F.col("y_scale") + F.col("y_center")).withColumn(
        "y_true", F.col("y") * F.col("y_scale") + F.col("y_center"))
    cm = {r.client_id: r for r in client_metrics(un).collect()}
    lo = {r.client_id: r.loss for r in huber_smape_loss(pr, ["client_id"]).collect()}
    for c in ("a", "b"):
        for m in ("mae", "rmse", "smape", "wmape"):
            assert ev[c][m] == pytest.approx(cm[c][m], rel=1e-12)
        assert ev[c].loss == pytest.approx(lo[c], rel=1e-12)
        assert ev[c].num_samples == 25


def _fit_fixture(spark):
    rng = np.random.default_rng(9)
    rows = [(c, "i", [float(v) for v in rng.normal(0, 1, 3)], float(rng.normal(0, 1))) for c, n in (("a", 30), ("b", 12)) for _ in range(n)]
    train = _as_blocks(spark, rows)
    params = spark.createDataFrame([("a", [0.1, 0.2, 0.3], 1.0, 0.0), ("b", [0.0, -0.1, 0.2], 0.5, 0.1)],
                                   "client_id string, body array<double>, a double, b double")
    ys = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0)], "client_id string, y_center double, y_scale double")
    return train, params, ys


def test_minibatch_with_one_batch_equals_full_batch(spark):
    from groupcast.operators.train import fit

    train, params, ys = _fit_fixture(spark)
    full = {r.client_id: r for r in fit(train, params, ys, 2, lr=0.01, batch_size=None).collect()}
    one = {r.client_id: r for r in fit(train, params, ys, 2, lr=0.01, batch_size=100).collect()}
    for c in ("a", "b"):
        assert one[c].body == pytest.approx(full[c].body, rel=1e-12)
        assert one[c].a == pytest.approx(full[c].a, rel=1e-12) and one[c].n == full[c].n


def test_minibatch_takes_more_steps(spark):
    from groupcast.operators.train import fit

    train, params, ys = _fit_fixture(spark)
    full = {r.client_id: r for r in fit(train, params, ys, 1, lr=0.01, batch_size=None).collect()}
    mb = {r.client_id: r for r in fit(train, params, ys, 1, lr=0.01, batch_size=10).collect()}
    # client a has 3 batches (3 Adam steps), b has 2: both move further than one full-batch step
    start = {"a": 1.0, "b": 0.5}
    for c in ("a", "b"):
        assert abs(mb[c].a - start[c]) > abs(full[c].a - start[c])
