"""Client files of names with spaces and signs, written and read back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from groupcast.sources import client_files as cf
from groupcast.sources.client_export import KINDS, write_client_files


@pytest.mark.parametrize("kind", KINDS)
def test_written_files_read_back(spark, tmp_path, kind):
    clients = ["MIDDLE EAST_A", "a+b 100%", "c"]
    rows = [(c, kind, f"i{k % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=k // 3), float(k) if k % 4 else None, k / 3, 0.1 * k, 1.0)
            for c in clients for k in range(30)]
    panel = spark.createDataFrame(rows, "client_id string, kind string, item_id string, date date, lag_7 double, quantity double, rolling_std_28 double, is_holiday double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a client over several batches
    try:
        made = write_client_files(panel, f"file://{tmp_path}/in").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.client_id, r.kind, r.rows) for r in made) == sorted((c, kind, 30) for c in clients)
    read = {"sqlite": cf.read_client_sqlite, "csv": cf.read_client_csv, "parquet": cf.read_client_parquet}[kind]
    cols = ["client_id", "item_id", "date", "lag_7", "quantity", "rolling_std_28", "is_holiday"]
    got = read(spark, f"{tmp_path}/in").select(cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *r[2:]) for r in rows), key=str)
    assert not [p for p in (tmp_path / "in").rglob(".*") if not p.name.endswith(".crc")]
    assert {r.client_id: r.kind for r in cf.pick_source(cf.source_listing(spark, f"{tmp_path}/in")).collect()} == dict.fromkeys(clients, kind)
    assert F is not None
