"""Client setup for all clients at once (reference: per-client setup loop).

split -> train-only scalers -> scaled rows -> blocks of series -> fallbacks.
The result tables are keyed by client_id; nothing is per-client in Python.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.constants import SEQ_LEN, TRAIN_RATIO, VAL_RATIO
from groupcast.operators.blocks import series_blocks, training_blocks, windows
from groupcast.operators.scale import apply_scaler, fit_robust, fit_standard
from groupcast.operators.split import target_rows
from groupcast.plans.selection import split_rows
from groupcast.session import settle


class Prepared:
    """Per-client setup tables, made when a caller first uses them. The split rows feed the scalers, the
    scaled rows and the client list, and the blocks feed everything after, so both are written once
    to the shared folder: the panel is computed once per preparation.

    split      complete rows with split, y (raw)
    x_stats    client_id, x_center[], x_scale[]
    y_stats    client_id, y_center, y_scale
    scaled     rows with scaled features and y, y_raw
    blocks     blocks of the scaled series (operators/blocks.py)
    sequences  client_id, item_id, split, target_date, x[], y, written out
    clients    client_id
    train      train blocks (+ fallbacks)
    eval       eval blocks (test, else val, else fallback)
    """

    def __init__(self, feature_cols: list[str], split: DataFrame, seq_len: int = SEQ_LEN):
        self.feature_cols = list(feature_cols)
        self._split = split
        self.seq_len = seq_len

    @property
    def dim(self) -> int:
        return self.seq_len * len(self.feature_cols)

    @cached_property
    def split(self) -> DataFrame:
        return settle(self._split)

    @cached_property
    def x_stats(self) -> DataFrame:
        return fit_standard(self.split, self.feature_cols)

    @cached_property
    def y_stats(self) -> DataFrame:
        return settle(fit_robust(self.split, "y"))

    @cached_property
    def scaled(self) -> DataFrame:
        return apply_scaler(self.split, self.x_stats, self.y_stats, self.feature_cols)

    @cached_property
    def blocks(self) -> DataFrame:
        return settle(series_blocks(self.scaled, self.feature_cols, "y", self.seq_len))

    @cached_property
    def sequences(self) -> DataFrame:
        return windows(self.blocks, self.dim)

    @cached_property
    def clients(self) -> DataFrame:
        return settle(self.split.select("client_id").distinct())

    @cached_property
    def _sets(self) -> tuple[DataFrame, DataFrame]:
        return training_blocks(self.blocks, self.clients, len(self.feature_cols), self.seq_len)

    @property
    def train(self) -> DataFrame:
        return self._sets[0]

    @property
    def eval(self) -> DataFrame:
        return self._sets[1]

    @cached_property
    def targets(self) -> DataFrame:
        """The split rows that are a sequence's target, with eval_split: the split its client is scored on (null: none)."""
        rows = target_rows(self.split, self.seq_len)
        seen = rows.groupBy("client_id").agg(F.max(F.col("split") == "test").alias("_t"), F.max(F.col("split") == "val").alias("_v"))
        pick = seen.select("client_id", F.when(F.col("_t"), "test").when(F.col("_v"), "val").alias("eval_split"))
        return rows.join(pick, "client_id")


def prepare(features: DataFrame, feature_cols: list[str], seq_len: int = SEQ_LEN,
            train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO) -> Prepared:
    return Prepared(feature_cols, split_rows(features, feature_cols, train_ratio, val_ratio), seq_len)


def naive_predictions(prep: Prepared) -> DataFrame:
    """Seasonal-naive forecast of the next-7-day total: 7 x the mean of the
    7 days before the target row (already a strictly-past feature). Gives
    metrics something to score before any model is trained. Forecast and
    raw target are columns of the row that is the eval target."""
    rows = prep.targets.filter(F.col("split") == F.col("eval_split"))
    return rows.select("client_id", "item_id", F.col("date").alias("target_date"),
                       (F.lit(7.0) * F.col("rolling_mean_7")).alias("y_pred"), F.col("y").alias("y_true"))
