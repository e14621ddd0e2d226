"""Scalers fitted per client on train rows only.

Statistics are kept in one row per client (arrays over features), so
applying them is a single equi-join on client_id; adaptive execution picks
the join from the measured size of the per-client side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupcast.constants import EPS
from groupcast.functions.quantiles import exact_quantiles


def fit_standard(split_df: DataFrame, feature_cols: list[str], fit_scope: str = "train") -> DataFrame:
    """F1 (F5 with fit_scope='all'): per client mean and population std of
    each feature; std 0 -> 1. Returns client_id, x_center, x_scale arrays."""
    df = split_df.filter(F.col("split") == "train") if fit_scope == "train" else split_df
    aggs = []
    for i, c in enumerate(feature_cols):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")]
    wide = df.groupBy("client_id").agg(*aggs)
    scale = [F.when(F.col(f"s{i}").isNull() | (F.col(f"s{i}") == 0.0), F.lit(1.0)).otherwise(F.col(f"s{i}")) for i in range(len(feature_cols))]
    return wide.select(
        "client_id",
        F.array(*[F.col(f"m{i}") for i in range(len(feature_cols))]).alias("x_center"),
        F.array(*scale).alias("x_scale"),
    )


def fit_robust(split_df: DataFrame, y_col: str = "y", fit_scope: str = "train") -> DataFrame:
    """per client median and IQR of the target (exact percentiles with
    linear interpolation, in memory that does not grow with a client's distinct values); IQR 0 -> 1.
    Returns client_id, y_center, y_scale."""
    df = split_df.filter(F.col("split") == "train") if fit_scope == "train" else split_df
    q = exact_quantiles(df, "client_id", y_col, [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.select(
        "client_id",
        F.col("q")[1].alias("y_center"),
        F.when(iqr == 0.0, F.lit(1.0)).otherwise(iqr).alias("y_scale"),
        F.col("q")[0].alias("y_q25"),
        F.col("q")[2].alias("y_q75"),
    )


def apply_scaler(df: DataFrame, x_stats: DataFrame | None, y_stats: DataFrame | None,
                 feature_cols: list[str], y_col: str = "y") -> DataFrame:
    """(x - center) / scale on every split with the train fit.
    The raw target is kept as ``y_raw``. A client without train rows has no
    fit and stops the job (E9)."""
    out = df
    if x_stats is not None:
        out = out.join(x_stats, "client_id", "left").withColumn("x_center", require_fit(F.col("x_center"), "array<double>"))
        out = out.select(
            *[c for c in df.columns if c not in feature_cols],
            *[((F.col(c).cast("double") - F.col("x_center")[i]) / F.col("x_scale")[i]).alias(c) for i, c in enumerate(feature_cols)],
        )
    if y_stats is not None:
        out = out.join(y_stats.select("client_id", "y_center", "y_scale"), "client_id", "left")
        out = out.withColumn("y_center", require_fit(F.col("y_center"), "double"))
        out = out.withColumn("y_raw", F.col(y_col)).withColumn(y_col, (F.col(y_col) - F.col("y_center")) / F.col("y_scale"))
    return out


def require_fit(stat: Column, kind: str) -> Column:
    """The client's fitted value; a client that has none stops the job."""
    message = F.concat(F.lit("client has no rows to fit on: "), F.col("client_id"))
    return F.coalesce(stat, F.raise_error(message).cast(kind))


def inverse_scale(c: Column, center: Column, scale: Column) -> Column:
    """x * scale + center."""
    return c * scale + center


def scaler_center_scale(center: Column, scale: Column) -> tuple[Column, Column]:
    """center and scale with the scale floored at 1e-8."""
    return center, F.greatest(scale, F.lit(EPS))


def standard_long(x_stats: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Long view of the standard scaler: client_id, feature, center, scale."""
    names = F.array(*[F.lit(c) for c in feature_cols])
    return x_stats.select(
        "client_id",
        F.explode(F.arrays_zip(names.alias("feature"), F.col("x_center").alias("center"), F.col("x_scale").alias("scale"))).alias("z"),
    ).select("client_id", "z.feature", "z.center", "z.scale")
