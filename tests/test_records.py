"""Run records: parameters, manifest, round metrics, comparison, results."""

import pytest
from pyspark.sql import functions as F


def test_params_write_read(spark, tmp_path):
    from groupcast.sources.records import read_params, write_params

    params = spark.createDataFrame([("a", [1.0, 2.0], 0.5, 0.1), ("b", [3.0, 4.0], 0.6, 0.2), ("c", [5.0, 6.0], 0.7, 0.3)],
                                   "client_id string, body array<double>, a double, b double")
    assign = spark.createDataFrame([("a", 0, False), ("b", 0, False), ("c", 1, True)], "client_id string, bubble int, is_isolated boolean")
    write_params(params, assign, str(tmp_path))
    clients = read_params(spark, str(tmp_path), "clients")
    assert clients.count() == 3 * 4
    bubbles = read_params(spark, str(tmp_path), "bubbles").orderBy("pos").collect()
    # shared part only, from the bubble's representative (lowest id = a)
    assert [(r.owner_id, r.layer, r.value) for r in bubbles] == [("0", "body.w", 1.0), ("0", "body.w", 2.0)]


def test_run_registry(spark, tmp_path):
    from groupcast.sources.records import latest_run, new_run_id, register_run, run_manifest

    registry = f"{tmp_path}/registry"
    old, new = "20260101_000000_000001", new_run_id()
    for rid in (new, old):
        register_run(run_manifest(spark, rid, f"/runs/{rid}/", {"config": "config.json", "models": "models/"}), registry)
    got = latest_run(spark, registry).collect()
    assert {r.name: r.path for r in got} == {"config": f"/runs/{new}/config.json", "models": f"/runs/{new}/models/"}
    assert {r.run_id for r in got} == {new}


def test_metrics_csv_of_unlike_shapes(spark, tmp_path):
    from groupcast.sources.records import write_metrics_csv

    a = spark.createDataFrame([("S", 1)], "strategy string, round int")
    b = spark.createDataFrame([("T", 2.0)], "strategy string, mae double")
    write_metrics_csv([a, b], f"{tmp_path}/m")
    got = spark.read.option("header", True).csv(f"{tmp_path}/m")
    assert got.columns == ["mae", "round", "strategy"]
    assert {tuple(r) for r in got.collect()} == {(None, "1", "S"), ("2.0", None, "T")}
    write_metrics_csv([a.limit(0)], f"{tmp_path}/empty")
    assert spark.read.text(f"{tmp_path}/empty").count() == 0
    with pytest.raises(ValueError):
        write_metrics_csv([], f"{tmp_path}/none")


def test_config_keeps_types(spark, tmp_path):
    import json

    from groupcast.sources.records import write_config

    config = {"selected_features": ["lag_7", "month"], "rounds": 100, "alpha": 0.1, "flags": {"x": True}}
    write_config(spark, config, f"{tmp_path}/c")
    assert json.loads(spark.read.text(f"{tmp_path}/c").first().value) == config


def test_flatten_history(spark):
    from groupcast.sources.records import flatten_history

    rec = spark.createDataFrame(
        [("S", 1, 0.5, [("a", 10, 2.0), ("b", 20, 3.0)], None), ("L", 2, 0.7, None, "c"), ("E", 3, 0.1, [], None)],
        "strategy string, round int, rmse double, per_client_metrics array<struct<client_id:string,num_samples:long,rmse:double>>,"
        " client_id string")
    got = {(r.strategy, r.round, r.client_id, r.rmse) for r in flatten_history(rec).collect()}
    assert got == {("S", 1, "a", 2.0), ("S", 1, "b", 3.0), ("L", 2, "c", 0.7)}


def test_round_metrics_and_comparison(spark):
    from groupcast.sources.records import compare_strategies, results_record, round_metrics

    rec = spark.createDataFrame(
        [("S", "federated", 1, 0, 1, "a", 10, 100, 2.0, 20.0), ("S", "federated", 1, 0, 1, "b", 30, 300, 4.0, 40.0)],
        "strategy string, stage string, round int, bubble int, epochs int, client_id string, num_samples long,"
        " train_samples long, rmse double, smape double")
    r = round_metrics(rec).first()
    assert r.num_samples == 40 and r.train_samples == 400
    assert r.rmse == pytest.approx((2.0 * 10 + 4.0 * 30) / 40) and r.clients == ["a", "b"]
    assert [m.client_id for m in r.per_client_metrics] == ["a", "b"]
    res = spark.createDataFrame([("S", 1.0, 2.0, 3.0, 4.0, 5.0)], "strategy string, rmse double, smape double, mae double, wmape double, mase double")
    cmp = compare_strategies(res).first()
    assert (cmp.rmse, cmp.mase) == (1.0, 5.0)
    rr = results_record(spark, "rid", res).first()
    assert rr.results["S"].rmse == 1.0 and rr.evaluation_split == "test"


def test_univariate_selector_agrees_on_clear_signal(spark):
    from groupcast.operators.select import f_scores, rank_features, select_univariate

    rows = [(float(i), float(i % 7), float((i * 37) % 11), 3.0 * i + (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "s double, w double, n double, y double")
    ours = [r.feature for r in rank_features(f_scores(df, ["s", "w", "n"], "y"), top_k=1).filter("selected").collect()]
    assert ours == ["s"]
    assert select_univariate(df, ["s", "w", "n"], "y", top_k=1) == ["s"]
    assert F is not None
