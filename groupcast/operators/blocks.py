"""Sequences as blocks of a series' rows.

A sequence is the ``seq_len`` rows before a target row of its run, a run being the rows of one
(client, item, split) in date order. Storing every sequence would hold each row ``seq_len`` times, so
what is stored is the run itself, cut into blocks of at most BLOCK_TARGETS targets, each with a halo of the
``seq_len`` rows before its first target:

    keys, block (0, 1, ...), n (targets), width (features a row), x (the (n + seq_len - 1) * width
    feature values, rows in order), y (n targets), y_before (the target before the first; null if none), target_date (n)

Target k of a block has the window x[k * width : (k + seq_len) * width]. Windows are never stored: a
prediction is a sum over the lags of products of rows and that lag's weights, and a gradient is a sum over rows of
products with the residuals that many rows later. ``windows`` writes them out for those who ask.

Runs are read as a stream from sorted partitions: the halo is carried from batch to batch, so a task holds a
batch and one block, however long a run is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.constants import SEQ_LEN

RUN = ["client_id", "item_id", "split"]
BLOCK_TARGETS = 512
COLUMNS = "block int, n int, width int, x array<double>, y array<double>, y_before double, target_date array<date>"


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a run starts: the first, and those that differ from the row before in a key."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        code = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


class _Cutter:
    """Sorted rows of runs to blocks."""

    def __init__(self, keys: list[str], features: list[str], seq_len: int, targets: int):
        self.keys, self.features, self.seq_len, self.targets = keys, features, seq_len, targets
        self.held: pa.Table | None = None  # rows of the open run from its next block's halo on
        self.block = 0  # that block's number
        self.found: list[tuple[int, int, int]] = []  # (first row in the table, targets, block number)

    def _run(self, first: int, rows: int, block: int, last: bool) -> int:
        """Note the run's blocks; returns how many were noted."""
        k = 0
        while rows - k * self.targets > self.seq_len:
            n = min(self.targets, rows - k * self.targets - self.seq_len)
            if n < self.targets and not last:
                break
            self.found.append((first + k * self.targets, n, block + k))
            k += 1
        return k

    def _batch(self, table: pa.Table) -> pa.RecordBatch | None:
        if not self.found:
            return None
        L, d = self.seq_len, len(self.features)
        x = np.column_stack([table.column(c).to_numpy() for c in self.features])
        y = table.column("y").to_numpy()
        dates = table.column("date").combine_chunks()
        first = np.array([f for f, _, _ in self.found])
        n = np.array([k for _, k, _ in self.found])
        block = np.array([b for _, _, b in self.found])
        rows = n + L - 1
        at_x = np.concatenate([[0], np.cumsum(rows)])
        at_y = np.concatenate([[0], np.cumsum(n)])
        pick_x = np.repeat(first - at_x[:-1], rows) + np.arange(at_x[-1])
        pick_y = np.repeat(first + L - at_y[:-1], n) + np.arange(at_y[-1])
        keys = [table.column(k).combine_chunks().take(pa.array(first)) for k in self.keys]
        self.found = []
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype("<i4")), values)
        return pa.RecordBatch.from_arrays(
            [
                *keys, pa.array(block, pa.int32()), pa.array(n, pa.int32()), pa.array(np.full(len(n), d), pa.int32()),
                lists(at_x * d, pa.array(x[pick_x].ravel())), lists(at_y, pa.array(y[pick_y])),
                pa.array(y[first + L - 1], mask=block == 0), lists(at_y, dates.take(pa.array(pick_y))),
            ],
            names=[*self.keys, *(c.split()[0] for c in COLUMNS.split(", "))],
        )

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            if self.held is not None:
                table = pa.concat_tables([self.held, table])
            if not table.num_rows:
                continue
            starts = [*_starts(table, self.keys).tolist(), table.num_rows]
            for p, q in zip(starts[:-2], starts[1:], strict=False):
                self._run(p, q - p, self.block, last=True)
                self.block = 0
            done = self._run(starts[-2], table.num_rows - starts[-2], self.block, last=False)
            made = self._batch(table)
            self.held = table.slice(starts[-2] + done * self.targets)
            self.block += done
            if made is not None:
                yield made
        if self.held is not None:
            self._run(0, self.held.num_rows, self.block, last=True)
            made = self._batch(self.held)
            if made is not None:
                yield made


def series_blocks(rows: DataFrame, feature_cols: list[str], y_col: str = "y", seq_len: int = SEQ_LEN,
                  keys: list[str] | None = None, targets: int = BLOCK_TARGETS) -> DataFrame:
    """E3 + E8 (E4 with ``keys`` of less than a series): blocks of the runs of ``rows`` in date order."""
    keys = RUN if keys is None else keys
    names = [f"x{i}" for i in range(len(feature_cols))]
    flat = rows.select(*keys, "date", F.col(y_col).cast("double").alias("y"),
                       *[F.col(c).cast("double").alias(n) for c, n in zip(feature_cols, names, strict=True)])
    dealt = (flat.repartition(*keys) if keys else flat.coalesce(1)).sortWithinPartitions(*keys, "date")
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), COLUMNS])
    return dealt.mapInArrow(lambda batches: _Cutter(keys, names, seq_len, targets)(batches), schema)


# ------------------------------------------------------------------ block arithmetic (numpy)
def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of arrays of doubles as numpy arrays (views)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[p:q] for p, q in zip(at[:-1], at[1:], strict=True)]


def lagged_scores(x: np.ndarray, width: int, body: np.ndarray) -> np.ndarray:
    """Window times weights for all targets of a block: one product of rows and weights per lag, added up."""
    rows, weights = x.reshape(-1, width), body.reshape(-1, width)
    n = len(rows) - len(weights) + 1
    part = rows @ weights.T  # one column per lag
    out = np.zeros(n)
    for lag in range(len(weights)):
        out += part[lag : lag + n, lag]
    return out


def lagged_sums(x: np.ndarray, width: int, seq_len: int, factor: np.ndarray) -> np.ndarray:
    """Sum over the targets of factor * window, flattened: one product of rows and factors per lag."""
    rows = x.reshape(-1, width)
    n = len(factor)
    return np.concatenate([factor @ rows[lag : lag + n] for lag in range(seq_len)])


def window_view(x: np.ndarray, width: int, dim: int) -> np.ndarray:
    """All windows of a block's rows as a view: (targets, dim), nothing copied."""
    return np.lib.stride_tricks.sliding_window_view(x, dim)[::width]


def windows(blocks: DataFrame, dim: int) -> DataFrame:
    """One row per sequence: the blocks' keys, target_date, x (its window, flattened time-major), y."""
    keys = blocks.columns[: blocks.columns.index("block")]
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                n, width = part.column("n")[0].as_py(), part.column("width")[0].as_py()
                flat = np.ascontiguousarray(window_view(arrays(part.column("x"))[0], width, dim)[:n]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(pa.array(np.zeros(n, np.int64))) for k in keys), part.column("target_date").flatten(),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="<i4") * dim), pa.array(flat)), part.column("y").flatten()],
                    names=[*keys, "target_date", "x", "y"],
                )

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "target_date date, x array<double>, y double"])
    return blocks.mapInArrow(run, schema)


# ------------------------------------------------------------------ counts, fallbacks, train and eval
def sequence_counts(blocks: DataFrame, clients: DataFrame) -> DataFrame:
    """Sequences per client and split: client_id, n_train, n_val, n_test; clients without any have zeros."""
    per = blocks.groupBy("client_id").agg(
        *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(F.lit(0))).alias(f"n_{s}") for s in ("train", "val", "test")])
    return clients.select("client_id").join(per, "client_id", "left").fillna(0)


def zero_blocks(clients: DataFrame, like: DataFrame, width: int, seq_len: int, split: str) -> DataFrame:
    """E5: one all-zero sequence (x = 0, y = 0 in scaled space) per client, as a block of one target."""
    made = {
        "client_id": F.col("client_id"), "item_id": F.lit("__fallback__"), "split": F.lit(split), "block": F.lit(0), "n": F.lit(1),
        "width": F.lit(width), "x": F.array_repeat(F.lit(0.0), width * seq_len), "y": F.array(F.lit(0.0)),
        "y_before": F.lit(None), "target_date": F.array(F.lit(None).cast("date")),
    }
    return clients.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in like.schema])


def training_blocks(blocks: DataFrame, clients: DataFrame, width: int, seq_len: int = SEQ_LEN) -> tuple[DataFrame, DataFrame]:
    """E5: train blocks (a zero sequence where a client has none) and eval blocks = test, else val, else a zero
    sequence (N12, N25). Adds is_fallback. The choice comes from counts, one row per client."""
    cnt = sequence_counts(blocks, clients)

    def with_zeros(some: DataFrame, lacking: DataFrame, split: str) -> DataFrame:
        zeros = zero_blocks(lacking, blocks, width, seq_len, split)
        return some.withColumn("is_fallback", F.lit(False)).unionByName(zeros.withColumn("is_fallback", F.lit(True)))

    train = with_zeros(blocks.filter(F.col("split") == "train"), cnt.filter(F.col("n_train") == 0), "train")
    pick = cnt.select("client_id", F.when(F.col("n_test") > 0, F.lit("test")).when(F.col("n_val") > 0, F.lit("val")).alias("_pick"))
    chosen = blocks.join(pick, "client_id").filter(F.col("split") == F.col("_pick")).drop("_pick")
    return train, with_zeros(chosen, cnt.filter((F.col("n_test") == 0) & (F.col("n_val") == 0)), "test")


def train_counts(train: DataFrame) -> DataFrame:
    """Sequences per client: client_id, n."""
    return train.groupBy("client_id").agg(F.sum("n").cast("long").alias("n"))


def shards(train: DataFrame, counts: DataFrame, per_shard: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with their shard, and the shards of each owner (client_id, shard)."""
    many = counts.select("client_id", F.greatest(F.ceil(F.col("n") / F.lit(float(per_shard))), F.lit(1)).cast("int").alias("_k"))
    dealt = train.join(many, "client_id").withColumn("shard", F.pmod(F.xxhash64("item_id", "split", "block"), F.col("_k")).cast("int")).drop("_k")
    return dealt, many.select("client_id", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("shard"))
