"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine
verification, distributed connected components.

Vectors of one label are hashed in TABLES tables of BITS sign bits each. A pair at cosine 0.98 agrees
on one bit with probability 1 - acos(0.98) / pi = 0.936, so on a table with 0.936 ** BITS and is
missed by all with (1 - 0.936 ** BITS) ** TABLES (1.2e-6 for 16 and 32); closer pairs less. Every
bucket that two vectors share is compared in full, in double precision.

Exact copies (same label, same components) are one class: copies link with each other, and a class
counts with its size. A bucket of more than CHUNK classes is cut into chunks by hash and each pair of
chunks is a task of its own, so a hot bucket is spread and none is capped. A pair is counted in the
first table whose bucket holds it, so counts need no list of pairs; of the pairs
themselves, only a spanning forest of each task (at most one link per vector) is written.

Cases: null labels, null or zero vectors and vectors with null, NaN or infinite components link with nothing
and are their own component; vectors of unlike length are never equal or compared; rows that repeat a vec_id are
vectors of their own with the same id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.llm.common import components, cut, small_batches

THRESHOLD = 0.98
BITS = 16
TABLES = 32
CHUNK = 1024
SEED = 5


def planes(dim: int, bits: int = BITS, tables: int = TABLES) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, bits * tables))


def signatures(vectors: np.ndarray, bits: int = BITS, tables: int = TABLES) -> np.ndarray:
    """One int32 per row and table."""
    sign = (vectors @ planes(vectors.shape[1], bits, tables) >= 0).reshape(len(vectors), tables, bits)
    return sign @ (1 << np.arange(bits, dtype=np.int32))


class Forest:
    """Union-find over 0..n-1 that says whether a link joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, key (label and components; null if the row links with nothing), e (double array), label."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    sound = (
        F.col("label").isNotNull()
        & F.col("e").isNotNull()
        & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("e", lambda x: x != 0)
    )
    positive = F.transform("e", lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one
    text = F.concat_ws(",", F.transform(positive, lambda x: x.cast("string")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"))
        .withColumn("sound", F.coalesce(sound, F.lit(False)))
        .withColumn("key", F.when(F.col("sound"), F.sha2(F.concat_ws(":", F.col("label").cast("string"), text), 256)))
    )


def bucket_links(node, weight, v, sig, chunk, t: int, low: int, high: int, threshold: float = THRESHOLD):
    """Links of one task, a bucket or two chunks of it: (places, number of vectors linked to each) and the
    pairs of places that join two trees. Pairs that an earlier table's bucket holds are left to it."""
    a, b = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    links, forest, edges = np.zeros(len(node), dtype=np.int64), Forest(len(node)), []
    for at in range(0, len(a), 32):  # of a dense bucket, 32 rows give up to 32 * CHUNK pairs at a time
        rows = a[at : at + 32]
        i, j = np.nonzero(v[rows] @ v[b].T >= threshold - 1e-9)
        i, j = rows[i], b[j]
        if low == high:
            once = i < j
            i, j = i[once], j[once]
        if not len(i):
            continue
        # The verified cosine: one dot product per pair, in double precision.
        sure = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
        if t:
            sure &= ~(sig[i, :t] == sig[j, :t]).any(axis=1)
        i, j = i[sure], j[sure]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        edges += [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
    found = np.flatnonzero(links)
    return found, links[found], edges


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    rows = cut(classes(vectors), "vectors")
    groups = cut(
        rows.where("key is not null and vec_id is not null").groupBy("key").agg(
            F.min("vec_id").alias("node"), F.count("*").alias("weight")
        ),
        "classes",
    )
    # One row per class holds its vector (the row of the smallest id; a repeated id is taken once).
    reps = (
        rows.where("key is not null").alias("r")
        .join(groups.alias("g"), (F.col("r.key") == F.col("g.key")) & (F.col("r.vec_id") == F.col("g.node")))
        .select("g.key", "g.node", "g.weight", "r.label", "r.e")
        .dropDuplicates(["key"])
        .select("node", "weight", "label", "e")
    )

    def sign(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["e"].map(len), sort=False):
                v = np.array(part["e"].tolist(), dtype=np.float64)
                # Scaling by the largest component keeps the squares of any finite vector finite.
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                out = part[["node", "weight", "label"]].copy()
                out["dim"] = dim
                sig = signatures(v)
                out["sigs"] = list(sig)
                out["sig"] = [x.tobytes() for x in sig]
                out["v"] = [x.tobytes() for x in v]
                yield out

    kind = "node long, weight long, label long, dim int, sigs array<int>, sig binary, v binary"
    signed = cut(reps.mapInPandas(sign, kind).withColumn("id", F.monotonically_increasing_id()), "signed")
    bucket = signed.select("id", "label", "dim", F.posexplode("sigs").alias("t", "s"))
    full = bucket.groupBy("label", "dim", "t", "s").agg(F.count("*").alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    member = bucket.join(full, ["label", "dim", "t", "s"]).select(
        "id", "label", "dim", "t", "s", chunks.alias("chunks"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk")
    )
    # Chunk c meets every chunk: task (low, high) gets both.
    meets = member.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "id", "label", "dim", "t", "s", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    )
    task = ["label", "dim", "t", "s", "low", "high"]

    def compare(batches):
        """Rows come in order of task: a task is at most 2 * CHUNK rows or so, tasks follow each other."""
        held: list[pd.DataFrame] = []

        def links(pdf: pd.DataFrame):
            out = []
            node, weight, chunk = (pdf[c].to_numpy() for c in ("node", "weight", "chunk"))
            keys = pdf[task].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                v = np.frombuffer(b"".join(pdf["v"].iloc[lo:hi])).reshape(hi - lo, -1)
                sig = np.frombuffer(b"".join(pdf["sig"].iloc[lo:hi]), dtype=np.int32).reshape(hi - lo, -1)
                t, low, high = (int(x) for x in (keys[lo, 2], keys[lo, 4], keys[lo, 5]))
                n = node[lo:hi]
                found, count, edges = bucket_links(n, weight[lo:hi], v, sig, chunk[lo:hi], t, low, high, threshold)
                out += zip(n[found].tolist(), n[found].tolist(), count.tolist(), strict=True)
                out += [(int(n[x]), int(n[y]), 0) for x, y in edges]
            return pd.DataFrame(out, columns=["a", "b", "n"]).astype("int64")

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
            last = (whole[task] == whole[task].iloc[-1]).all(axis=1).to_numpy()
            open_from = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0
            if open_from:
                yield links(whole.iloc[:open_from].reset_index(drop=True))
            held = [whole.iloc[open_from:].reset_index(drop=True)]
        if held:
            yield links(held[0])

    rows_of_tasks = meets.join(signed.select("id", "node", "weight", "sig", "v"), "id").drop("id")
    found = cut(
        rows_of_tasks.repartition(*task).sortWithinPartitions(*task).mapInPandas(compare, "a long, b long, n long"), "links"
    )
    counts = found.groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(found.where("a != b").select("a", "b"))
    per_class = (
        groups.join(counts, groups.node == counts.a, "left")
        .join(roots.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
        .select("key", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("top"))
    )
    out = rows.join(per_class, "key", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("top", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
