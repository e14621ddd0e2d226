"""Step 1 of the build plan: which features predict next-week sales,
measured on train rows only (D1 -> D2 -> D3..D7 -> B5 -> E1 -> G1 -> G3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupcast.constants import CANDIDATE_FEATURES, FEATURE_ALPHA, FEATURE_TOP_K, TRAIN_RATIO, VAL_RATIO
from groupcast.operators.panel import choose_target, drop_incomplete, feature_panel, require_columns
from groupcast.operators.select import f_scores, rank_features
from groupcast.operators.split import chrono_split


def split_rows(features: DataFrame, feature_cols: list[str] | None = None,
               train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO) -> DataFrame:
    """Complete rows (features + target) with ``y`` and ``split``."""
    cols = list(feature_cols or CANDIDATE_FEATURES)
    require_columns(features, cols)
    target = choose_target(features)
    complete = drop_incomplete(features, cols + [target]).withColumn("y", F.col(target).cast("double"))
    return chrono_split(complete, train_ratio, val_ratio)


def feature_ranking(spark: SparkSession, sf_dir: str, source: str = "tpch", top_k: int = FEATURE_TOP_K,
                    alpha: float = FEATURE_ALPHA, with_pvalue: bool = True) -> DataFrame:
    feats = feature_panel(spark, sf_dir, source)
    train = split_rows(feats).filter(F.col("split") == "train")
    return rank_features(f_scores(train, CANDIDATE_FEATURES, "y"), top_k, alpha, with_pvalue)
