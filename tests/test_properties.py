"""Property tests (hypothesis) for the numeric building blocks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

def _norm(v):
    v = np.maximum(np.asarray(v, dtype=float), 0)
    s = v.sum()
    return v / s if s > 0 else np.full(len(v), 1.0 / len(v))


def test_array_properties_on_many_rows(spark):
    from groupcast.functions.arrays import array_l2_norm, array_sum, clip_l2, normalise_distribution

    rng = np.random.default_rng(3)
    rows = [([float(x) for x in rng.normal(0, 1, 8)],) for _ in range(300)]
    df = spark.createDataFrame(rows, "v array<double>")
    out = df.select(array_sum(normalise_distribution("v")).alias("s"), array_l2_norm(clip_l2("v", 0.15)).alias("n"),
                    F.array_min(normalise_distribution("v")).alias("mn")).collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in out)
    assert all(r.n <= 0.15 + 1e-12 for r in out)
    assert all(r.mn >= 0.0 for r in out)


def test_weighted_mean_between_min_and_max(spark):
    from groupcast.operators.metrics import weighted_metrics

    rng = np.random.default_rng(5)
    rows = [("s", f"c{i}", int(rng.integers(1, 50)), *[float(x) for x in rng.uniform(0, 10, 5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "strategy string, client_id string, num_samples long, rmse double, smape double, mae double, wmape double, mase double")
    w = weighted_metrics(df, ["strategy"]).first()
    for m in ["rmse", "smape", "mae", "wmape", "mase"]:
        vals = [r[3 + ["rmse", "smape", "mae", "wmape", "mase"].index(m)] for r in rows]
        assert min(vals) - 1e-9 <= w[m] <= max(vals) + 1e-9


def test_split_covers_each_row_once(spark):
    import datetime as dt

    from groupcast.operators.split import chrono_split

    rng = np.random.default_rng(11)
    rows = []
    for item in range(6):
        n = int(rng.integers(1, 60))
        for k in range(n):
            rows.append(("c", f"i{item}", dt.date(2021, 1, 1) + dt.timedelta(days=k)))
    df = spark.createDataFrame(rows, "client_id string, item_id string, date date")
    s = chrono_split(df)
    assert s.count() == len(rows)
    assert s.select("client_id", "item_id", "date").distinct().count() == len(rows)
    late_train = s.alias("a").join(s.alias("b"), ["client_id", "item_id"]).filter(
        (F.col("a.split") == "train") & (F.col("b.split") != "train") & (F.col("a.date") > F.col("b.date")))
    assert late_train.count() == 0
