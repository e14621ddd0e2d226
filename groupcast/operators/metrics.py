"""Forecast metrics per client and per strategy.

Everything is a grouped aggregate (partial-aggregated before its shuffle).
The naive error of MASE needs the train targets in (item, date) order per
client; instead of a window over a whole client, it is the sum of
within-item differences (window per item) plus the jumps between
consecutive items (a window over one row per item).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupcast.constants import EPS
from groupcast.operators.scale import inverse_scale, scaler_center_scale

METRICS = ["rmse", "smape", "mae", "wmape", "mase"]


def naive_mae(train_targets: DataFrame, y_col: str = "y_true") -> DataFrame:
    """Mean |y_t - y_(t-1)| over a client's train targets concatenated
    in (item asc, date asc) order; floor 1e-8; <= 1 target -> 1e-8."""
    w_item = Window.partitionBy("client_id", "item_id").orderBy("target_date")
    diffs = train_targets.withColumn("_d", F.abs(F.col(y_col) - F.lag(y_col).over(w_item)))
    per_item = diffs.groupBy("client_id", "item_id").agg(
        F.sum(F.coalesce("_d", F.lit(0.0))).alias("s"),
        F.count(F.lit(1)).alias("n"),
        F.min_by(y_col, "target_date").alias("first_y"),
        F.max_by(y_col, "target_date").alias("last_y"),
    )
    w_c = Window.partitionBy("client_id").orderBy("item_id")
    jumps = per_item.withColumn("_j", F.abs(F.col("first_y") - F.lag("last_y").over(w_c)))
    per_client = jumps.groupBy("client_id").agg(
        (F.sum("s") + F.sum(F.coalesce("_j", F.lit(0.0)))).alias("abs_diff"), F.sum("n").alias("n")
    )
    nm = F.when(F.col("n") > 1, F.greatest(F.col("abs_diff") / (F.col("n") - 1).cast("double"), F.lit(EPS))).otherwise(F.lit(EPS))
    return per_client.select("client_id", nm.alias("naive_mae"))


def client_metrics(pred: DataFrame, naive: DataFrame | None = None, y_col: str = "y_true", p_col: str = "y_pred") -> DataFrame:
    """L1-L5 (+ L7 counting): per client mae, rmse, smape (x100), wmape, mase."""
    e = F.col(p_col) - F.col(y_col)
    agg = pred.groupBy("client_id").agg(
        F.count(F.lit(1)).cast("long").alias("num_samples"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(100.0) * F.avg(F.lit(2.0) * F.abs(e) / (F.abs(F.col(y_col)) + F.abs(F.col(p_col)) + F.lit(EPS)))).alias("smape"),
        (F.sum(F.abs(e)) / (F.sum(F.abs(F.col(y_col))) + F.lit(EPS))).alias("wmape"),
    )
    if naive is None:
        return agg.withColumn("mase", F.lit(None).cast("double"))
    return agg.join(naive, "client_id", "left").withColumn(
        "mase", F.col("mae") / F.coalesce(F.col("naive_mae"), F.lit(EPS))
    ).drop("naive_mae")


def weighted_metrics(per_client: DataFrame, group_cols: list[str], weight: str = "num_samples") -> DataFrame:
    """Sample-weighted mean of each metric over clients (not pooled)."""
    w = F.col(weight).cast("double")
    return per_client.groupBy(*group_cols).agg(
        F.sum(weight).cast("long").alias("num_samples"),
        *[(F.sum(F.coalesce(F.col(m), F.lit(0.0)) * w) / F.sum(w)).alias(m) for m in METRICS],
    )


def strategy_metrics(per_client: DataFrame, strategies: DataFrame | None = None) -> DataFrame:
    """Per strategy weighted means; a strategy with no records -> 0.0."""
    agg = weighted_metrics(per_client, ["strategy"])
    if strategies is None:
        return agg
    return strategies.join(agg, "strategy", "left").select(
        "strategy", F.coalesce("num_samples", F.lit(0)).cast("long").alias("num_samples"),
        *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in METRICS],
    )


def huber_smape_loss(pred: DataFrame, group_cols: list[str], delta: float = 1.0, smape_weight: float = 0.1,
                     p_col: str = "p_scaled", t_col: str = "y", center: str = "y_center", scale: str = "y_scale") -> DataFrame:
    """K1: mean Huber (scaled space) + w * mean SMAPE on unscaled values."""
    e = F.col(p_col) - F.col(t_col)
    ae = F.abs(e)
    huber = F.when(ae <= delta, F.lit(0.5) * e * e).otherwise(F.lit(delta) * (ae - F.lit(0.5 * delta)))
    by = scaler_center_scale(F.col(center), F.col(scale))
    pu, tu = inverse_scale(F.col(p_col), *by), inverse_scale(F.col(t_col), *by)
    smape = F.lit(2.0) * F.abs(pu - tu) / (F.abs(tu) + F.abs(pu) + F.lit(EPS))
    loss = F.avg(huber) + (F.lit(smape_weight) * F.avg(smape) if smape_weight > 0 else F.lit(0.0))
    return pred.groupBy(*group_cols).agg(loss.alias("loss"), F.count(F.lit(1)).cast("long").alias("num_samples"))
