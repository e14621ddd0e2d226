"""Panel construction and per-series features.

The panel is keyed (client_id, item_id, date). Order only exists inside the
per-series window ``series_window()``; every window here is partitioned by
(client_id, item_id), so one shuffle serves all of them and one task never
holds more than a set of whole series. A series is bounded by its number of
days, not by the size of the raw tables, because raw rows are aggregated to
one row per day first (with map-side partial aggregation, which absorbs a hot
client before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groupcast.constants import CANDIDATE_FEATURES, HOLIDAYS_MM_DD
from groupcast.functions.columns import safe_div
from groupcast.session import settle
from groupcast.sources.tables import read_table

KEYS = ["client_id", "item_id"]


def series_window(extra_keys: list[str] | None = None, order: str = "date"):
    return Window.partitionBy(*(KEYS + (extra_keys or []))).orderBy(order)


# --------------------------------------------------------------------- D1
def tpch_panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sale lines with their group keys: one row per line item.

    client = region name '_' market segment, item = part type,
    date = order date. Every side is projected to the columns it needs (the
    scans read only those). AQE broadcasts a side once its measured size is
    under ``spark.sql.autoBroadcastJoinThreshold`` and keeps a shuffle join
    when it is not.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    cu = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    na = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    re = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    pa = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])

    # nation (25 rows) and region (5 rows) are fixed-size by the schema's
    # definition, so broadcasting them is bounded whatever the scale factor.
    geo = na.join(F.broadcast(re), na.n_regionkey == re.r_regionkey).select("n_nationkey", "r_name")
    cust = cu.join(F.broadcast(geo), cu.c_nationkey == geo.n_nationkey).select(
        "c_custkey", F.concat_ws("_", "r_name", "c_mktsegment").alias("client_id")
    )
    # Orders get their client first (an orders-sized join on custkey), so
    # the lineitem-sized data is shuffled only for the orderkey and partkey
    # joins (two exchanges of the fact table instead of three at scale).
    orders_c = od.join(cust, od.o_custkey == cust.c_custkey).select("o_orderkey", "client_id", "o_orderdate")
    return (
        li.join(orders_c, li.l_orderkey == orders_c.o_orderkey)
        .join(pa, li.l_partkey == pa.p_partkey)
        .select(
            "client_id",
            F.col("p_type").alias("item_id"),
            F.to_date("o_orderdate").alias("date"),
            F.col("l_quantity").alias("quantity"),
            safe_div(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        )
    )


def build_panel(rows: DataFrame) -> DataFrame:
    """One row per (client, item, day): total quantity, mean unit price."""
    return rows.groupBy("client_id", "item_id", "date").agg(
        F.sum("quantity").alias("quantity"), F.avg("unit_price").alias("sell_price")
    )


def events_panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second panel from ``events``: client = event_type, item = user_id."""
    ev = read_table(spark, sf_dir, "events", ["ts", "user_id", "event_type", "value"])
    return ev.select(
        F.col("event_type").alias("client_id"),
        F.col("user_id").cast("string").alias("item_id"),
        F.to_date("ts").alias("date"),
        F.lit(1.0).alias("quantity"),
        F.col("value").cast("double").alias("unit_price"),
    )


# --------------------------------------------------------------------- D2
def series_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_series(panel: DataFrame) -> DataFrame:
    """Hash-partition the (aggregated, small) daily panel by series.

    Every later window is partitioned by (client, item[, split]), which this
    partitioning satisfies, so it is the only exchange of the feature,
    split and sequence stages. The count is explicit so AQE does not fold
    the densified, window-heavy work into one task because the shuffled
    input was small in bytes."""
    return panel.repartition(series_partitions(panel.sparkSession), *KEYS)


def densify_calendar(panel: DataFrame) -> DataFrame:
    """One row per calendar day from a series' first sale to the panel's end.

    Filled days get quantity 0 and the last seen price. Each observed day is
    expanded to itself plus the empty days before the next observed day (the
    last one to the panel's last day, a scalar subquery), so no calendar table and
    no join are needed: one window (``lead``) and an ``explode`` over the already
    partitioned series.
    """
    w = series_window()
    end = panel.agg(F.max("date")).scalar()
    last_day_covered = F.coalesce(F.date_sub(F.lead("date").over(w), 1), end)
    return (
        by_series(panel)
        .withColumn("_until", last_day_covered)
        .select(
            "client_id",
            "item_id",
            "quantity",
            "sell_price",
            F.col("date").alias("obs_date"),
            F.explode(F.sequence(F.col("date"), F.col("_until"))).alias("date"),
        )
        .withColumn("quantity", F.when(F.col("date") == F.col("obs_date"), F.col("quantity")).otherwise(F.lit(0.0)))
        .drop("obs_date")
    )


# --------------------------------------------------------------------- D3-D7, B7
def _rolling(col: str, k: int, fn) -> Column:
    w = series_window().rowsBetween(-k, -1)
    return F.when(F.count(F.lit(1)).over(w) == k, fn(F.col(col)).over(w))


def add_features(dense: DataFrame, with_target: bool = True) -> DataFrame:
    """Lags, strictly-past rolling stats, price change,
    calendar flags and the next-7-day target. All windows share one
    partitioning, so the plan has a single exchange for all of them."""
    w = series_window()
    q, p, d = F.col("quantity"), F.col("sell_price"), F.col("date")
    prev_p = F.lag("sell_price", 1).over(w)
    cols = {
        "dayofweek": F.weekday(d).cast("double"),
        "month": F.month(d).cast("double"),
        "is_weekend": (F.weekday(d) >= 5).cast("double"),
        "is_holiday": F.date_format(d, "MM-dd").isin(HOLIDAYS_MM_DD).cast("double"),
        "lag_7": F.lag(q, 7).over(w),
        "lag_14": F.lag(q, 14).over(w),
        "lag_28": F.lag(q, 28).over(w),
        "rolling_mean_7": _rolling("quantity", 7, F.avg),
        "rolling_std_7": _rolling("quantity", 7, F.stddev_samp),
        "rolling_mean_28": _rolling("quantity", 28, F.avg),
        "rolling_std_28": _rolling("quantity", 28, F.stddev_samp),
        "price_change_rate": F.coalesce(safe_div(p - prev_p, prev_p), F.lit(0.0)),
        "week_of_year": F.weekofyear(d).cast("double"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("double"),
        "is_month_end": (d == F.last_day(d)).cast("double"),
    }
    out = dense.select("client_id", "item_id", "date", "quantity", "sell_price", *[v.alias(k) for k, v in cols.items()])
    if with_target:
        fw = w.rowsBetween(1, 7)
        out = out.withColumn("target_7d", F.when(F.count(F.lit(1)).over(fw) == 7, F.sum(q).over(fw)))
    return out.select("client_id", "item_id", "date", "quantity", *CANDIDATE_FEATURES, *(["target_7d"] if with_target else []))


# --------------------------------------------------------------------- B1-B6
def require_columns(df: DataFrame, cols: list[str], owner: str = "panel") -> None:
    """Fail before any job when wanted columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"{owner}: no column named {', '.join(missing)}")


def choose_target(df: DataFrame) -> str:
    """target_7d when the column exists, else quantity."""
    return "target_7d" if "target_7d" in df.columns else "quantity"


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows null (or NaN, as pandas counts it) in any of ``cols``."""
    cond = F.lit(True)
    types = dict(df.dtypes)
    for c in cols:
        ok = F.col(c).isNotNull()
        if types.get(c) in ("double", "float"):
            ok = ok & ~F.isnan(F.col(c))
        cond = cond & ok
    return df.filter(cond)


def parse_date(df: DataFrame, source_col: str) -> DataFrame:
    """Text or timestamp to date in column ``date``."""
    return df.withColumn("date", F.to_date(F.col(source_col)))


def calendar_basic(df: DataFrame) -> DataFrame:
    """Monday=0 weekday and month."""
    return df.withColumn("dayofweek", F.weekday("date").cast("double")).withColumn("month", F.month("date").cast("double"))


# --------------------------------------------------------------------- composition
def feature_panel(spark: SparkSession, sf_dir: str, source: str = "tpch") -> DataFrame:
    """Raw tables -> daily panel -> dense calendar -> 16 candidate features + target."""
    rows = tpch_panel_rows(spark, sf_dir) if source == "tpch" else events_panel_rows(spark, sf_dir)
    # Written once: its last day is needed before its rows are densified, and the joins run only once.
    return add_features(densify_calendar(settle(build_panel(rows))))
