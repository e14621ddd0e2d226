"""Committed rounds: what a training run needs to go on where it stopped.

Every step of a run (a warm-up round, a training round, a tuning phase) ends with a commit: its tables are written to the
run's folder first, then one row with their paths is appended to the folder's ``commits`` table. A step
counts only once that row is there, so a driver or job lost in between leaves files that nobody reads, and the
step is taken again. A run given the same folder starts after its last commits.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groupcast.session import checkpoint_folder

COMMITS = "phase string, step int, tables string"


class RoundLog:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{checkpoint_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}").rstrip("/")

    def commit(self, phase: str, step: int, **tables: DataFrame) -> dict[str, DataFrame]:
        """Write the step's tables, then the row that makes them count; returns the tables as written."""
        said = {}
        for name, df in tables.items():
            path = f"{self.folder}/{phase}/{step}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            said[name] = {"path": path, "schema": df.schema.json()}
        row = self.spark.createDataFrame([(phase, step, json.dumps(said))], COMMITS)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return self._open(said)

    def _open(self, said: dict) -> dict[str, DataFrame]:
        return {k: self.spark.read.schema(StructType.fromJson(json.loads(v["schema"]))).parquet(v["path"]) for k, v in said.items()}

    def steps(self, phase: str) -> dict[int, dict[str, DataFrame]]:
        """The committed steps of a phase, in order: step -> its tables. Of a step committed twice one counts."""
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits").filter(F.col("phase") == phase).collect()
        except AnalysisException:  # nothing committed yet
            return {}
        return {r.step: self._open(json.loads(r.tables)) for r in sorted(rows, key=lambda r: (r.step, r.tables))}

    def once(self, phase: str, step: int, make) -> dict[str, DataFrame]:
        """The step's tables: those committed, or else what ``make()`` returns (name -> DataFrame), committed now."""
        done = self.steps(phase)
        return done[step] if step in done else self.commit(phase, step, **make())
