"""A numbered log on the shared store: entry n + 1 is created only if it is absent.

A writer puts its data under a path of its own first, then claims the next number by creating that entry's file; if another
writer was faster, the file exists, and the next number is tried. So entries are numbered 1, 2, .. without gaps or
repeats however many write at once, and an entry's data is whole when the entry is there. A writer that dies before its
claim leaves data that no entry names.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "{:012d}.json"


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this content unless it exists; whether it was created. On a local (or mounted) folder a whole
    file is linked to its name, on other stores the store's own create-without-overwrite decides."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        local = target.toUri().getPath()
        whole = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(whole, "x") as out:
            out.write(text)
        try:
            os.link(whole, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(whole)
    if fs.exists(target):
        return False
    try:
        out = fs.create(target, False)
    except Exception:  # the store's answer when another writer was faster; anything else shows below
        if fs.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def data_path(self) -> str:
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def entries(self) -> DataFrame:
        """number, body (JSON) of the entries, numbers from the files' names."""
        found = self.spark.read.text(f"{self.folder}/log", wholetext=True)
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        return found.select(F.substring_index(name, ".", 1).cast("long").alias("number"), F.col("value").alias("body"))

    def read(self) -> list[tuple[int, dict]]:
        """The entries in order (one per commit of a run: clusterings, runs); empty without a log."""
        try:
            return [(r.number, json.loads(r.body)) for r in self.entries().orderBy("number").collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def append(self, body: dict) -> int:
        """Add an entry; its number."""
        n = max((k for k, _ in self.read()), default=0) + 1
        while not create_new(self.spark, f"{self.folder}/log/{ENTRY.format(n)}", json.dumps(body, sort_keys=True)):
            n += 1
        return n
