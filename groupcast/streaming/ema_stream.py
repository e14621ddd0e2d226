"""EMA of client vectors across rounds, in a state store.

Each round's vectors are appended to a folder that a stream reads; its state, keyed by (scope, client_id), is the
client's smoothed vector. State, offsets and outputs lie in the stream's folder on the shared store, so a new driver given
that folder goes on with equal vectors. A round that is sent again (its driver was lost before it was committed)
starts from the vector before that round, so sending twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groupcast.constants import EMA_ALPHA
from groupcast.operators.cluster import SCOPE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VECTORS = f"{SCOPE} string, client_id string, round long, vector array<double>"


def smooth(old: list[float] | None, new: list[float], alpha: float) -> list[float]:
    """alpha * old + (1 - alpha) * new; a change of length starts anew."""
    if old is None or len(old) != len(new):
        return [float(v) for v in new]
    return [alpha * p + (1.0 - alpha) * q for p, q in zip(old, new, strict=True)]


class EmaProcessor(StatefulProcessor):
    """State of a key: its last round, and the vectors before and after it."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "round long, before array<double>, after array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = sorted(((int(r), v) for part in rows for r, v in zip(part["round"], part["vector"], strict=True)), key=lambda z: z[0])
        last, before, after = self.state.get() if self.state.exists() else (None, None, None)
        out = []
        for rnd, vector in taken:
            if last is None or rnd > last:
                last, before = rnd, after
            elif rnd < last:
                continue  # sent again long after: what followed it stands
            after = smooth(before, vector, self.alpha)
            out.append((*key, rnd, after))
        self.state.update((last, before, after))
        yield pd.DataFrame(out, columns=[SCOPE, "client_id", "round", "vector"])

    def close(self) -> None:
        pass


class EmaStream:
    """The stream over one folder; ``update`` sends a round and returns its smoothed vectors."""

    def __init__(self, spark: SparkSession, folder: str, alpha: float = EMA_ALPHA):
        self.spark, self.folder, self.alpha = spark, folder.rstrip("/"), alpha

    def update(self, current: DataFrame, rnd: int, col: str = "dist") -> DataFrame:
        """Smooth ``current`` (scope, client_id, col) with the state; the same columns. Runs the stream to its end."""
        sent = current.select(SCOPE, "client_id", F.lit(rnd).cast("long").alias("round"), F.col(col).cast("array<double>").alias("vector"))
        sent.write.mode("append").parquet(f"{self.folder}/vectors")
        self._run()
        done = self.spark.read.schema(VECTORS).parquet(f"{self.folder}/smoothed").filter(F.col("round") == rnd)
        return done.dropDuplicates([SCOPE, "client_id"]).select(SCOPE, "client_id", F.col("vector").alias(col))

    def rounds(self) -> list[int]:
        try:
            return sorted(r.round for r in self.spark.read.schema(VECTORS).parquet(f"{self.folder}/smoothed").select("round").distinct().collect())
        except AnalysisException:  # no round yet
            return []

    def _run(self) -> None:
        conf = "spark.sql.streaming.stateStore.providerClass"
        before = self.spark.conf.get(conf)
        self.spark.conf.set(conf, ROCKS)
        try:
            vectors = self.spark.readStream.schema(VECTORS).parquet(f"{self.folder}/vectors")
            smoothed = vectors.groupBy(SCOPE, "client_id").transformWithStateInPandas(
                EmaProcessor(self.alpha), outputStructType=VECTORS, outputMode="Append", timeMode="None")
            query = (
                smoothed.writeStream.format("parquet").option("path", f"{self.folder}/smoothed")
                .option("checkpointLocation", f"{self.folder}/state").outputMode("append").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        finally:
            self.spark.conf.set(conf, before)
