"""Helpers shared by the operators: the shared scratch folder, batches, word splitting, components."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds, so that a Python worker keeps a few MB of text at a time.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests,
    a plain local session) a folder under the warehouse, which a cluster shares too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends in files that
    every executor can read, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of df has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs run inside; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: bytes.translate tables: A-Z lowered; the second also turns every ASCII byte
#: that is neither a letter nor a digit into a space. (bytes.split() cuts at 0x09-0x0D and 0x20.)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lowered, as UTF-8."""
    return text.encode().translate(LOWER).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z lowered, as UTF-8."""
    return text.encode().translate(LOWER_WORDS).split() if text else []


class WordHashes(dict):
    """word -> 8 bytes of xxh3, remembered for the words met so far (bounded)."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8")


def mix64(x):
    """splitmix64 finaliser over a uint64 array."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words, k: int):
    """One 64-bit hash per k consecutive word hashes, in order."""
    import numpy as np

    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return out


def bit_filter(hashes: DataFrame, column: str, bits: int):
    """Bits set at hash mod ``bits``, as bytes: combined before it is collected, bits / 64 rows at most."""
    import numpy as np

    at = F.pmod(F.col(column), F.lit(bits))
    rows = (
        hashes.select(F.shiftright(at, 6).cast("int").alias("w"), at.cast("int").bitwiseAND(63).alias("b"))
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
        .collect()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    if rows:
        out[[r.w for r in rows]] = [r.v for r in rows]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long edges as (node, root), root the smallest
    node, for every node of an edge. Alternates large-star and small-star steps;
    each round is written to the shared folder. A hub's rows meet in a join that
    adaptive execution can split; minima are combined before the shuffle."""
    current = cut(
        edges.where("a != b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "cc"
    )

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def ensure_dir(uri: str) -> None:
    """Make a folder of the shared store, whatever store it is."""
    from pyarrow import fs

    store, path = open_store(uri)
    if isinstance(store, fs.LocalFileSystem):
        os.makedirs(path, exist_ok=True)
    else:
        store.create_dir(path, recursive=True)


def open_store(uri: str):
    """(file system, path) of a folder or file that Spark names by URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
