"""Feature selection by univariate F test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupcast.constants import FEATURE_ALPHA, FEATURE_TOP_K
from groupcast.functions.columns import safe_div
from groupcast.functions.stats import with_f1_pvalue

MAX_DOUBLE = 1.7976931348623157e308


def f_scores(train: DataFrame, feature_cols: list[str], y_col: str = "y") -> DataFrame:
    """G1: F = r^2 / (1 - r^2) * (n - 2) per feature on the pooled rows.

    One wide aggregate (covariance and variances of every feature with y,
    partial-aggregated per task), then the 16 results are unpivoted.
    ``corr`` is not used: it raises on a constant column under ANSI mode, and
    a constant column must give F = 0 (p = 1), as the sanitised original.
    """
    y = F.col(y_col).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("vy")]
    for i, c in enumerate(feature_cols):
        x = F.col(c).cast("double")
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.var_pop(x).alias(f"v{i}")]
    one = train.agg(*aggs)
    rows = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), F.col(f"c{i}").alias("cov"), F.col(f"v{i}").alias("vx"))
            for i, c in enumerate(feature_cols)
        ])
    )
    long = one.select("n", "vy", rows.alias("r")).select("n", "vy", "r.*")
    r2 = safe_div(F.col("cov") * F.col("cov"), F.col("vx") * F.col("vy"))
    fval = (
        F.when(r2.isNull() | F.isnan(r2), F.lit(0.0))
        .when(r2 >= 1.0, F.lit(MAX_DOUBLE))
        .otherwise(r2 / (F.lit(1.0) - r2) * (F.col("n") - F.lit(2)).cast("double"))
    )
    return long.select("feature", "pos", F.col("n").cast("long").alias("n"), fval.alias("f_score"))


def add_pvalues(scores: DataFrame) -> DataFrame:
    """G2 + B12: p = P(F(1, n-2) > F); non-finite p -> 1."""
    return with_f1_pvalue(scores.withColumn("_dof", F.col("n").cast("double") - 2.0), "f_score", "_dof").drop("_dof")


def rank_features(scores: DataFrame, top_k: int = FEATURE_TOP_K, alpha: float = FEATURE_ALPHA,
                  with_pvalue: bool = True) -> DataFrame:
    """Rank by (p asc, F desc, name asc); flag significant and selected.

    Selected = the first top_k ranks whatever alpha is (significant
    features are a prefix of this order). The window sees one row per
    candidate feature (16), so its single partition is bounded.
    """
    df = add_pvalues(scores) if with_pvalue and "p_value" not in scores.columns else scores
    order = ([F.col("p_value").asc()] if "p_value" in df.columns else []) + [F.col("f_score").desc(), F.col("feature").asc()]
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= F.lit(top_k))
    if "p_value" in out.columns:
        out = out.withColumn("significant", F.col("p_value") <= F.lit(alpha))
    return out


def selected_features(ranked: DataFrame) -> list[str]:
    """The chosen names in rank order (at most 16 short strings to the driver)."""
    return [r.feature for r in ranked.filter("selected").orderBy("rank").select("feature").collect()]


def selection_summary(train: DataFrame) -> DataFrame:
    """Train rows per client -> total, clients, min / max / mean."""
    per = train.groupBy("client_id").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.sum("c").cast("long").alias("total_samples"),
        F.count(F.lit(1)).cast("long").alias("num_clients"),
        F.min("c").cast("long").alias("min_samples"),
        F.max("c").cast("long").alias("max_samples"),
        F.avg("c").alias("mean_samples"),
    )


def select_univariate(train: DataFrame, feature_cols: list[str], y_col: str, top_k: int = FEATURE_TOP_K) -> list[str]:
    """MLlib cross-check of the chosen set (continuous F test)."""
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler

    va = VectorAssembler(inputCols=feature_cols, outputCol="_features", handleInvalid="skip")
    sel = UnivariateFeatureSelector(featuresCol="_features", labelCol=y_col, outputCol="_sel", selectionMode="numTopFeatures")
    sel.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(top_k)
    model = sel.fit(va.transform(train.select(*feature_cols, F.col(y_col).cast("double").alias(y_col))))
    return [feature_cols[i] for i in model.selectedFeatures]
