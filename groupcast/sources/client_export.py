"""Writing a feature panel as per-client files, in the layouts that client_files.py reads.

A client's rows come to one task, sorted, and go to its file as they stream by, so a task holds one batch. A file gets
its name when it is whole; a task that runs again writes the same file. The folder must be mounted on all machines (SQLite
needs a POSIX path).
"""

from __future__ import annotations

import os
import sqlite3
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

KINDS = ("sqlite", "csv", "parquet")
#: Every so many rows of a CSV client, one goes to valid.csv.
VALID_EVERY = 5


class _Files:
    """The open files of one client: written under names of their own, named at the end."""

    def __init__(self, folder: str, client: str, kind: str):
        self.kind, self.rows, self.mark = kind, 0, f".{uuid.uuid4().hex}"
        home = folder if kind == "sqlite" else f"{folder}/{client}"
        os.makedirs(home, exist_ok=True)
        names = {"sqlite": [f"client_{client}.db"], "csv": ["train.csv", "valid.csv"], "parquet": ["features.parquet"]}[kind]
        self.paths = [(f"{home}/{self.mark}{n}", f"{home}/{n}") for n in names]
        self.writers: list = []

    def add(self, part: pa.Table) -> None:
        if self.kind == "sqlite":
            self._sqlite(part)
        elif self.kind == "csv":
            named = part.rename_columns([{"quantity": "sales", "is_holiday": "event_flag"}.get(c, c) for c in part.column_names])
            self.writers = self.writers or [pc.CSVWriter(tmp, named.schema) for tmp, _ in self.paths]
            held = (np.arange(self.rows, self.rows + len(part)) % VALID_EVERY) == VALID_EVERY - 1
            for w, rows in zip(self.writers, (~held, held), strict=True):
                w.write_table(named.filter(pa.array(rows)))
        else:
            self.writers = self.writers or [pq.ParquetWriter(self.paths[0][0], part.schema)]
            self.writers[0].write_table(part)
        self.rows += len(part)

    def _sqlite(self, part: pa.Table) -> None:
        features = [c for c in part.column_names if c not in ("item_id", "date", "quantity")]
        if not self.writers:
            con = sqlite3.connect(self.paths[0][0])
            columns = ", ".join(f'"{c}" REAL' for c in features)
            con.execute(f"CREATE TABLE FEATURES (item_id TEXT, sale_date TEXT, {columns})")
            con.execute("CREATE TABLE SALES_RECORDS (item_id TEXT, sale_date TEXT, sales REAL)")
            self.writers = [con]
        values = {c: part.column(c).to_pylist() for c in part.column_names}
        self.writers[0].executemany(f"INSERT INTO FEATURES VALUES ({', '.join('?' * (2 + len(features)))})",
                                    zip(values["item_id"], values["date"], *(values[c] for c in features), strict=True))
        self.writers[0].executemany("INSERT INTO SALES_RECORDS VALUES (?, ?, ?)", zip(values["item_id"], values["date"], values["quantity"], strict=True))

    def close(self) -> None:
        for w in self.writers:
            if self.kind == "sqlite":
                w.commit()
            w.close()
        for tmp, path in self.paths:
            os.replace(tmp, path)


def write_client_files(panel: DataFrame, folder: str) -> DataFrame:
    """One client's files per client_id of ``panel`` (client_id, kind, item_id, date, quantity, features ..), ``kind`` one
    of KINDS. Runs the job; returns what was written: client_id, kind, rows."""
    where = folder.removeprefix("file://").removeprefix("file:").rstrip("/")

    def run(batches):
        client, files = None, None
        done: list[tuple] = []
        for b in batches:
            table = pa.Table.from_batches([b])
            ids = table.column("client_id").to_pylist()
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for p, q in zip(edges, edges[1:], strict=False):
                if p == q:
                    continue
                if ids[p] != client:
                    if files is not None:
                        files.close()
                        done.append((client, files.kind, files.rows))
                    client, files = ids[p], _Files(where, ids[p], table.column("kind")[p].as_py())
                files.add(table.slice(p, q - p).drop_columns(["client_id", "kind"]))
        if files is not None:
            files.close()
            done.append((client, files.kind, files.rows))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["client_id", "kind", "rows"])

    from groupcast.session import settle

    text = panel.withColumn("date", panel["date"].cast("string"))
    return settle(text.repartition("client_id").sortWithinPartitions("client_id", "item_id", "date").mapInArrow(run, "client_id string, kind string, rows long"))
