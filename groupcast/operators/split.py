"""Chronological split, sequences, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupcast.constants import SEQ_LEN, TRAIN_RATIO, VAL_RATIO
from groupcast.functions.columns import hash_uniform
from groupcast.operators.blocks import series_blocks, windows

KEYS = ["client_id", "item_id"]


def chrono_split(df: DataFrame, train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO,
                 order: str = "date") -> DataFrame:
    """Per (client, item), first floor(n*t) rows train, up to
    floor(n*(t+v)) val, the rest test. The ratios are added first, then
    multiplied in double, as the original does. Adds ``split`` and ``rn``."""
    w = Window.partitionBy(*KEYS).orderBy(order)
    wn = Window.partitionBy(*KEYS)
    n = F.count(F.lit(1)).over(wn).cast("double")
    rn = F.row_number().over(w)
    train_end = F.floor(n * F.lit(float(train_ratio)))
    val_end = F.floor(n * F.lit(float(train_ratio + val_ratio)))
    return df.withColumn("rn", rn).withColumn(
        "split",
        F.when(F.col("rn") <= train_end, F.lit("train")).when(F.col("rn") <= val_end, F.lit("val")).otherwise(F.lit("test")),
    )


def split_summary(split_df: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """E2 (+ E5 fallbacks, N25): per client rows and sequences per split.

    Sequence count of an (item, split) run is max(0, rows - L). Fallbacks:
    no train sequence -> 1; no test sequence -> val count if > 0, else 1.
    Two aggregations: per (client, item, split), then per client; both are
    partial-aggregated before their shuffle.
    """
    per = split_df.groupBy("client_id", "item_id", "split").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("seqs", F.greatest(F.col("n") - F.lit(seq_len), F.lit(0)))

    def s(col, split):
        return F.sum(F.when(F.col("split") == split, F.col(col)).otherwise(F.lit(0))).cast("long")

    out = per.groupBy("client_id").agg(
        F.sum("n").cast("long").alias("raw_rows"),
        s("n", "train").alias("train_rows"),
        s("n", "val").alias("val_rows"),
        s("n", "test").alias("test_rows"),
        s("seqs", "train").alias("train_seq_raw"),
        s("seqs", "val").alias("val_sequences"),
        s("seqs", "test").alias("test_seq_raw"),
        F.countDistinct("item_id").cast("long").alias("num_items"),
    )
    return out.select(
        "client_id", "raw_rows", "train_rows", "val_rows", "test_rows",
        F.when(F.col("train_seq_raw") > 0, F.col("train_seq_raw")).otherwise(F.lit(1)).cast("long").alias("train_sequences"),
        "val_sequences",
        F.when(F.col("test_seq_raw") > 0, F.col("test_seq_raw"))
        .when(F.col("val_sequences") > 0, F.col("val_sequences"))
        .otherwise(F.lit(1)).cast("long").alias("test_sequences"),
        "num_items",
    )


def make_sequences(split_df: DataFrame, feature_cols: list[str], y_col: str = "y", seq_len: int = SEQ_LEN,
                   group_keys: list[str] | None = None) -> DataFrame:
    """E3/E4 + E8 written out: one row per sequence (keys, target_date, x = the flattened window, time-major, y).
    The operators that train, score and profile read the blocks and never store these."""
    return windows(series_blocks(split_df, feature_cols, y_col, seq_len, group_keys), seq_len * len(feature_cols))


def target_rows(split_df: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """The rows that are a sequence's target: those with ``seq_len`` rows before them in their
    (client, item, split) run."""
    w = Window.partitionBy("client_id", "item_id", "split").orderBy("date")
    return split_df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") > seq_len).drop("_pos")


def sample_per_client(df: DataFrame, n: int, seed: int, key_cols: list[str], buckets: int = 64) -> DataFrame:
    """At most n rows per client without replacement: the n rows with the
    smallest hash of (row key, seed), so the sample does not depend on
    partitioning or retries.

    Exact and skew-safe in two steps: first keep the top n inside each
    (client, hash bucket) window, which splits a hot client over ``buckets``
    tasks; every row of the client's top n is in its bucket's top n, so the
    second ranking over the client sees at most n * buckets candidates.
    """
    u = hash_uniform(*key_cols, seed=seed)
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in key_cols]), F.lit(buckets))
    w1 = Window.partitionBy("client_id", "_b").orderBy("_u", *key_cols)
    w2 = Window.partitionBy("client_id").orderBy("_u", *key_cols)
    return (
        df.withColumn("_u", u)
        .withColumn("_b", bucket)
        .withColumn("_rk", F.row_number().over(w1))
        .filter(F.col("_rk") <= n)
        .withColumn("_rk", F.row_number().over(w2))
        .filter(F.col("_rk") <= n)
        .drop("_rk", "_u", "_b")
    )
