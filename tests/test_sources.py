"""Per-client file sources and run records, round-tripped through files
written from the sf0.001 panel."""

import os
import sqlite3

from pyspark.sql import functions as F

from groupcast.constants import CANDIDATE_FEATURES
from tests.conftest import SF_SMALL


def _panel(spark, clients):
    from groupcast.operators.panel import feature_panel

    f = feature_panel(spark, SF_SMALL).filter(F.col("client_id").isin(clients))
    return f.withColumn("date", F.date_format("date", "yyyy-MM-dd")).toPandas()


def test_three_layouts(spark, tmp_path):
    from groupcast.sources.client_files import discover_clients, load_panel, source_listing, pick_source

    clients = ["AFRICA_AUTOMOBILE", "ASIA_BUILDING", "EUROPE_MACHINERY"]
    pdf = _panel(spark, clients)
    d = str(tmp_path)
    # client 0: sqlite
    a = pdf[pdf.client_id == clients[0]]
    con = sqlite3.connect(os.path.join(d, f"client_{clients[0]}.db"))
    feats = a[["item_id", "date", *[c for c in CANDIDATE_FEATURES if c not in ("dayofweek", "month")], "target_7d"]].rename(columns={"date": "sale_date"})
    feats.to_sql("FEATURES", con, index=False)
    a[["item_id", "date", "quantity"]].rename(columns={"date": "sale_date", "quantity": "sales"}).to_sql("SALES_RECORDS", con, index=False)
    con.close()
    # client 1: csv pair, renamed columns, no rolling_std_28
    b = pdf[pdf.client_id == clients[1]].drop(columns=["client_id", "rolling_std_28", "dayofweek", "month"])
    b = b.rename(columns={"quantity": "sales", "is_holiday": "event_flag"})
    os.makedirs(os.path.join(d, clients[1]))
    cut = int(len(b) * 0.8)
    b.iloc[:cut].to_csv(os.path.join(d, clients[1], "train.csv"), index=False)
    b.iloc[cut:].to_csv(os.path.join(d, clients[1], "valid.csv"), index=False)
    # client 2: parquet with sale_date
    c = pdf[pdf.client_id == clients[2]].drop(columns=["client_id", "dayofweek", "month"]).rename(columns={"date": "sale_date"})
    os.makedirs(os.path.join(d, clients[2]))
    c.to_parquet(os.path.join(d, clients[2], "features.parquet"), index=False)

    assert [r.client_id for r in discover_clients(spark, d).collect()] == [clients[0]]
    chosen = {r.client_id: r.kind for r in pick_source(source_listing(spark, d)).collect()}
    assert chosen == {clients[0]: "sqlite", clients[1]: "csv", clients[2]: "parquet"}

    panel = load_panel(spark, d, CANDIDATE_FEATURES)
    got = {r.client_id: r["count"] for r in panel.groupBy("client_id").count().collect()}
    want = pdf.groupby("client_id").size().to_dict()
    assert got == {c: len(g.dropna(subset=[f for f in CANDIDATE_FEATURES if c != clients[1] or f != "rolling_std_28"] + ["target_7d"]))
                   for c, g in pdf.groupby("client_id")}
    assert panel.columns == ["client_id", "item_id", "date", *CANDIDATE_FEATURES, "y"]
    assert {r.client_id: r["count"] for r in load_panel(spark, d).groupBy("client_id").count().collect()} == want
    csv_std = panel.filter(F.col("client_id") == clients[1]).agg(F.max("rolling_std_28")).first()[0]
    assert csv_std == 0.0
    sq = panel.filter(F.col("client_id") == clients[0]).orderBy("item_id", "date").first()
    assert sq.dayofweek == sq.date.weekday()


def test_records_roundtrip(spark, tmp_path):
    from groupcast.sources.records import append_cluster_history, read_cluster_history, read_profiles_json, render_report, write_profiles_json

    prof = spark.createDataFrame([("a", [0.1, 0.9]), ("b", [0.5, 0.5])], "client_id string, importance array<double>")
    p = str(tmp_path / "profiles")
    write_profiles_json(prof, p)
    back = {r.client_id: r.importance for r in read_profiles_json(spark, p).collect()}
    assert back == {"a": [0.1, 0.9], "b": [0.5, 0.5]}

    from groupcast.operators.cluster import cluster_record

    assign = spark.createDataFrame([("all", "a", 0, 2, False, 2, 3), ("all", "b", 0, 2, False, 2, 3), ("all", "c", 1, 1, True, 2, 3)],
                                   "scope string, client_id string, cluster_id int, cluster_size int, is_isolated boolean, k_star int, n_clients int")
    rec = cluster_record(assign, "initial_clustering", 0)
    r = rec.first()
    assert r.cluster_sizes == [2, 1] and r.isolated_clients == ["c"] and r.assignments == {"a": 0, "b": 0, "c": 1}
    h = str(tmp_path / "hist")
    append_cluster_history(rec, h, reset=True)
    members = {(x.client_id, x.bubble, x.is_isolated) for x in read_cluster_history(spark, h).collect()}
    assert members == {("a", 0, False), ("b", 0, False), ("c", None, True)}
    alone = assign.limit(1).withColumn("cluster_size", F.lit(1)).withColumn("is_isolated", F.lit(True))
    added = append_cluster_history(cluster_record(alone, "dynamic_recluster", 20), h)
    assert added.first().sequence == 2
    assert [tuple(x) for x in read_cluster_history(spark, h).collect()] == [("a", None, True)]

    res = spark.createDataFrame([("Local", 1.0, 2.0, 3.0, 4.0, 5.0)], "strategy string, rmse double, smape double, mae double, wmape double, mase double")
    line = render_report(res, ["Local"]).first().line
    assert line == "Local | rmse 1.0000 | smape 2.0000 | mae 3.0000 | wmape 4.0000 | mase 5.0000"


def test_history_layouts(spark, tmp_path):
    import json

    import pytest

    from groupcast.sources.records import read_cluster_history

    def read(name, doc):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(doc, indent=1))
        return {tuple(r) for r in read_cluster_history(spark, str(path)).collect()}

    single = {"sequence": 1, "multi_client_bubbles": [{"bubble_id": 0, "size": 2, "clients": ["a", "b"]}], "isolated_clients": ["c"]}
    want = {("a", 0, False), ("b", 0, False), ("c", None, True)}
    assert read("single", single) == want
    last = {"sequence": 2, "multi_client_bubbles": [], "isolated_clients": ["x"]}
    assert read("records", {"schema_version": 3, "records": [single, last]}) == {("x", None, True)}
    assert read("legacy", {"assignments": {"a": 0, "b": 0, "c": 1}, "isolated_clients": ["c"]}) == want
    # a bubble of one client counts as isolated
    assert read("alone", {"assignments": {"a": 0, "b": 0, "c": 1}, "isolated_clients": []}) == want
    with pytest.raises(Exception, match="without members"):
        read("compact", {"multi_client_bubbles": [{"bubble_id": 0, "size": 2}], "isolated_clients": []})


def test_csv_clients_with_unlike_headers(spark, tmp_path):
    from groupcast.sources.client_files import read_client_csv

    for client, name, text in [
        ("a", "train.csv", "date,item_id,sales,sell_price,rolling_std_28\n2020-01-01,i1,3,1.5,0.7\n"),
        ("a", "valid.csv", "item_id,date,sales,sell_price,rolling_std_28\n\"i1\",2020-01-02,4,1.6,\n"),
        ("b", "train.csv", "sell_price,quantity,event_flag,item_id,date,extra\r\n2.5,7,1,i9,2020-01-03,5\r\n"),
        ("b", "valid.csv", "item_id,date\n"),
    ]:
        (tmp_path / client).mkdir(exist_ok=True)
        (tmp_path / client / name).write_text(text, newline="")
    got = {(r.client_id, str(r.date)): r for r in read_client_csv(spark, str(tmp_path)).collect()}
    assert len(got) == 3
    assert (got["a", "2020-01-01"].quantity, got["a", "2020-01-01"].rolling_std_28) == (3.0, 0.7)
    assert got["a", "2020-01-02"].item_id == "i1" and got["a", "2020-01-02"].rolling_std_28 is None
    b = got["b", "2020-01-03"]
    assert (b.sell_price, b.quantity, b.is_holiday, b.extra, b.rolling_std_28) == (2.5, 7.0, 1.0, 5.0, 0.0)


def test_parquet_clients_with_unlike_columns(spark, tmp_path):
    import pandas as pd
    import pytest

    from groupcast.sources.client_files import load_panel, read_client_parquet

    for client, frame in {
        "a": pd.DataFrame({"item_id": ["i"], "date": ["2020-01-01"], "quantity": [1.0]}),
        "b": pd.DataFrame({"item_id": ["i"], "sale_date": ["2020-01-02"], "quantity": [2.0], "extra": [9.0]}),
    }.items():
        (tmp_path / client).mkdir()
        frame.to_parquet(tmp_path / client / "features.parquet", index=False)
    got = {r.client_id: r for r in read_client_parquet(spark, str(tmp_path)).collect()}
    assert str(got["a"].date) == "2020-01-01" and str(got["b"].date) == "2020-01-02"
    assert got["a"].extra is None and got["b"].extra == 9.0
    with pytest.raises(Exception):
        load_panel(spark, str(tmp_path / "missing")).count()


def test_client_without_train_rows_stops(spark):
    import datetime as dt

    import pytest

    from groupcast.plans.prepare import prepare

    days = [("a", "i", dt.date(2020, 1, 1) + dt.timedelta(days=k), float(k), float(k)) for k in range(30)]
    rows = days + [("b", "i", dt.date(2020, 1, 1), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "client_id string, item_id string, date date, f double, quantity double")
    with pytest.raises(Exception, match="no rows to fit on: b"):
        prepare(df, ["f"]).scaled.collect()


def _stores(tmp_path, clients, rows):
    for c in clients:
        con = sqlite3.connect(tmp_path / f"client_{c}.db")
        con.execute("CREATE TABLE FEATURES (item_id INTEGER, sale_date DATE, lag_7 REAL, note TEXT)")
        con.executemany("INSERT INTO FEATURES VALUES (?, ?, ?, ?)", [(k % 50, f"2020-01-{k % 28 + 1:02d}", k / 4, None if k % 3 else f"n{k}") for k in range(rows)])
        con.execute("DELETE FROM FEATURES WHERE rowid % 7 = 0")
        con.commit()
        con.close()


def test_sqlite_large_file_is_read_in_parts(spark, tmp_path):
    from groupcast.sources.client_files import read_sqlite_table

    _stores(tmp_path, ["a", "b"], 4000)
    df = read_sqlite_table(spark, str(tmp_path), "FEATURES", part_bytes=20_000)
    assert df.dtypes == [("client_id", "string"), ("item_id", "bigint"), ("sale_date", "string"), ("lag_7", "double"), ("note", "string")]
    parts = df.withColumn("p", F.spark_partition_id()).groupBy("client_id").agg(F.countDistinct("p").alias("parts"), F.count("*").alias("n"), F.countDistinct("lag_7").alias("d"))
    want = sum(1 for k in range(1, 4001) if k % 7)
    for r in parts.collect():
        assert r.parts > 3 and r.n == r.d == want
    narrow = read_sqlite_table(spark, str(tmp_path), "FEATURES", "client_id string, lag_7 double")
    assert narrow.columns == ["client_id", "lag_7"] and narrow.count() == 2 * want


def test_sqlite_filters_reach_the_file(spark, tmp_path):
    from groupcast.sources import client_files as cf

    _stores(tmp_path, ["a", "b", "c"], 200)
    df = cf.read_sqlite_table(spark, str(tmp_path), "FEATURES")
    some = df.filter((F.col("item_id") == 7) & (F.col("lag_7") > 3.0) & F.col("client_id").isin("a", "c"))
    whole = [(c, k % 50, k / 4) for c in "abc" for k in range(200) if (k + 1) % 7]
    assert sorted((r.client_id, r.item_id, r.lag_7) for r in some.collect()) == sorted(w for w in whole if w[0] in "ac" and w[1] == 7 and w[2] > 3)
    assert df.filter("note IS NULL").count() == 3 * sum(1 for k in range(200) if (k + 1) % 7 and k % 3)
    assert df.filter("sale_date >= '2020-01-10' AND note = 'n9'").count() == 3
    # What the reader asks of SQLite
    reader = cf._SqliteReader({"table": "FEATURES"}, df.schema, [(str(tmp_path / f"client_{c}.db"), 1) for c in "abc"])
    given = [cf.EqualTo(("item_id",), 7), cf.GreaterThan(("lag_7",), 3.0), cf.In(("client_id",), ("a", "c")), cf.GreaterThan(("sale_date",), "2020-01-10")]
    assert list(reader.pushFilters(given)) == given  # Spark applies them again
    assert [os.path.basename(p.path) for p in reader.partitions()] == ["client_a.db", "client_c.db"]
    con = sqlite3.connect(tmp_path / "client_a.db")
    sql, values = reader._sql(con, reader.partitions()[0])
    assert sql.endswith('WHERE "item_id" IN (?) AND "lag_7" > ?') and values == [7, 3.0]
    con.close()


def test_metrics_csv_of_a_failing_job_leaves_no_part(spark, tmp_path):
    import pytest

    from groupcast.sources.records import write_metrics_csv

    good = spark.range(0, 40, 1, 4).select(F.col("id").alias("round"), (F.col("id") * 1.5).alias("mae"))
    write_metrics_csv([good], f"{tmp_path}/good")
    assert len([f for f in os.listdir(tmp_path / "good") if f.startswith("part-")]) == 4
    assert spark.read.option("header", True).csv(f"{tmp_path}/good").count() == 40
    bad = good.withColumn("mae", F.when(F.col("round") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("mae")))
    with pytest.raises(Exception, match="lost"):
        write_metrics_csv([bad], f"{tmp_path}/bad")
    left = os.listdir(tmp_path / "bad") if (tmp_path / "bad").exists() else []
    assert not [f for f in left if f.startswith("part-") or f == "_SUCCESS"]
