"""Client profiles and privacy noise.

H2 grows boosted trees per client. H1 stands in for it with a closed form: the squared
correlation of every flattened sequence position with the target,
normalised to sum 1. It is one grouped aggregate per client over a vector
column (MLlib ``Summarizer``: JVM side, partial-aggregated, no explode), so
a hot client is combined map-side before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupcast.constants import CLIP_NORM, DEFAULT_EPSILON, SEED, SEQ_LEN
from groupcast.functions.columns import hash_uniform, laplace_from_uniform
from groupcast.operators.blocks import arrays, lagged_sums, shards, train_counts


#: Sequences that one task grows trees on
GBT_SHARD = 1 << 16


def row_moments(rows: DataFrame, group_col: str = "client_id", x_col: str = "x", y_col: str = "y") -> DataFrame:
    """Per group the mean of [x, x*y, x*x, y, y*y] over rows with an array x: group_col, d (size of x), m."""
    x = F.col(x_col)
    y = F.col(y_col).cast("double")
    n = F.size(x)
    yv = F.array_repeat(y, n)
    packed = F.concat(x, F.zip_with(x, yv, lambda v, w: v * w), F.transform(x, lambda v: v * v), F.array(y, y * y))
    s = rows.select(group_col, n.alias("_d"), array_to_vector(packed).alias("_v"))
    return s.groupBy(group_col).agg(F.max("_d").alias("d"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("m"))


def sequence_moments(blocks: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """The same over the sequences of blocks, x being the flattened window: sums over the lags of products with the
    rows, per block; Spark adds the blocks up."""
    def run(batches):
        for b in batches:
            sums, widths = [], b.column("width").to_pylist()
            for x, y, width in zip(arrays(b.column("x")), arrays(b.column("y")), widths, strict=True):
                ones = np.ones(len(y))
                sums.append(np.concatenate([
                    lagged_sums(x, width, seq_len, ones), lagged_sums(x, width, seq_len, y), lagged_sums(x * x, width, seq_len, ones),
                    [y.sum(), y @ y]]))
            yield pa.RecordBatch.from_arrays([b.column("client_id"), b.column("n").cast(pa.int64()), pa.array(sums, pa.list_(pa.float64()))],
                                             names=["client_id", "n", "sums"])

    per = blocks.select("client_id", "n", "width", "x", "y").mapInArrow(run, "client_id string, n long, sums array<double>")
    agg = per.groupBy("client_id").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s"))
    each = F.transform(F.arrays_zip(F.col("s").alias("v"), F.array_repeat("n", F.size("s")).alias("n")), lambda z: z["v"] / z["n"])
    return agg.select("client_id", F.floor((F.size("s") - 2) / 3).cast("int").alias("d"), each.alias("m"))


def importance_long(mo: DataFrame, group_col: str = "client_id") -> DataFrame:
    """H1 in long form from the moments: group_col, pos, importance (r^2 share, sums to 1)."""
    # The moments of a position side by side, then one row per position: no row carries the whole vector.
    d = F.col("d")
    each = F.arrays_zip(F.slice("m", F.lit(1), d).alias("x"), F.slice("m", d + 1, d).alias("xy"), F.slice("m", 2 * d + 1, d).alias("xx"))
    ends = mo.select(group_col, each.alias("each"), F.element_at("m", 3 * d + 1).alias("_y"), F.element_at("m", 3 * d + 2).alias("_yy"))
    ex = ends.select(group_col, "_y", "_yy", F.posexplode("each").alias("pos", "e"))
    ex_, exy, exx = F.col("e.x"), F.col("e.xy"), F.col("e.xx")
    ey, eyy = F.col("_y"), F.col("_yy")
    cov, vx, vy = exy - ex_ * ey, exx - ex_ * ex_, eyy - ey * ey
    den = vx * vy
    r2 = F.when(den > 0.0, F.least(cov * cov / den, F.lit(1.0))).otherwise(F.lit(0.0))
    long = ex.select(group_col, "pos", r2.alias("r2"))
    tot = F.sum("r2").over(Window.partitionBy(group_col))
    return long.select(group_col, "pos", F.when(tot > 0.0, F.col("r2") / tot).otherwise(F.col("r2")).alias("importance"))


def to_array(long: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, pos, value) rows -> one array per key in position order."""
    return long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("_s")).select(
        key, F.transform("_s", lambda s: s[value]).alias(out))


def importance_r2(mo: DataFrame, group_col: str = "client_id") -> DataFrame:
    """H1: per group, r^2 of each x position with y, normalised to sum 1
    (all-zero when no position correlates). Returns group_col, importance[].

    Moments come from one vector aggregate; the per-position arithmetic is
    done on (group, position) rows, never on data rows."""
    return to_array(importance_long(mo, group_col), group_col, "importance", "importance")


def importance_gbt(train: DataFrame, counts: DataFrame | None = None, seq_len: int = SEQ_LEN, per_shard: int = GBT_SHARD,
                   **trees) -> DataFrame:
    """H2: importance by boosted trees: per client and window position the average gain of its splits, as shares that
    sum to 1 (all zero when nothing splits). client_id, pos, importance.

    All clients in one job: a client's blocks are dealt to shards, each shard grows its trees where it lies (its windows as
    one byte a value), and gains and numbers of splits are added up per client and position. Histograms of all nodes and
    bins would be far larger than a client's binned rows, so rows travel once and histograms never; a client
    of more than ``per_shard`` sequences gets the sum over the trees of its shards."""
    from groupcast.functions.boosting import split_gains

    dealt, _ = shards(train, train_counts(train) if counts is None else counts, per_shard)

    def run(key, data):
        data = data.sort_by([("item_id", "ascending"), ("split", "ascending"), ("block", "ascending")])
        width = data.column("width")[0].as_py()
        parts = list(zip(arrays(data.column("x")), arrays(data.column("y")), strict=True))
        gain, count = split_gains(parts, width, width * seq_len, **trees)
        return pa.table({"client_id": pa.array([key[0].as_py()] * len(gain)), "pos": pa.array(range(len(gain)), pa.int32()), "gain": gain, "splits": count})

    per = dealt.select("client_id", "shard", "item_id", "split", "block", "width", "x", "y").groupBy("client_id", "shard").applyInArrow(
        run, "client_id string, pos int, gain double, splits double")
    mean = per.groupBy("client_id", "pos").agg(F.sum("gain").alias("g"), F.sum("splits").alias("k")).select(
        "client_id", "pos", F.coalesce(F.col("g") / F.nullif(F.col("k"), F.lit(0.0)), F.lit(0.0)).alias("v"))
    tot = F.sum("v").over(Window.partitionBy("client_id"))
    return mean.select("client_id", "pos", F.when(tot > 0.0, F.col("v") / tot).otherwise(F.col("v")).alias("importance"))


def l2_clip(long: DataFrame, clip: float = CLIP_NORM, key: str = "client_id") -> DataFrame:
    """H3: scale a vector (key, pos, importance rows) by clip/||v|| when ||v|| > clip."""
    norm = F.sqrt(F.sum(F.col("importance") * F.col("importance")).over(Window.partitionBy(key)))
    scaled = F.when(F.col("_n") > clip, F.col("importance") * (F.lit(clip) / F.col("_n"))).otherwise(F.col("importance"))
    return long.withColumn("_n", norm).withColumn("importance", scaled).drop("_n")


def laplace_noise(long: DataFrame, epsilon: float = DEFAULT_EPSILON, clip: float = CLIP_NORM, seed: int = SEED,
                  key: str = "client_id") -> DataFrame:
    """H4: add Laplace(0, clip/epsilon) to every element; epsilon <= 0 -> none.

    The uniform for position i of key k is a hash of (k, i, seed), so noise
    is reproducible and independent of partitioning (the same expression is
    written in SQL)."""
    if epsilon <= 0:
        return long
    u = hash_uniform(F.col(key), F.col("pos"), seed=seed)
    return long.withColumn("importance", F.col("importance") + laplace_from_uniform(u, float(clip) / float(epsilon)))


def _profiles(importance: DataFrame, epsilon: float, clip: float, seed: int) -> DataFrame:
    noisy = laplace_noise(l2_clip(importance, clip), epsilon, clip, seed)
    return to_array(noisy, "client_id", "importance", "importance").withColumn("sensitivity", F.lit(float(clip)))


def profile_clients(train: DataFrame, epsilon: float = DEFAULT_EPSILON, clip: float = CLIP_NORM,
                    seed: int = SEED, seq_len: int = SEQ_LEN, by: str = "r2") -> DataFrame:
    """H5: the sequences of train blocks -> importance (``by`` r2 or gbt) -> clip -> noise.
    Returns client_id, importance[] (noisy), sensitivity."""
    found = importance_long(sequence_moments(train, seq_len)) if by == "r2" else importance_gbt(train, seq_len=seq_len)
    return _profiles(found, epsilon, clip, seed)


def profile_all_raw(rows: DataFrame, feature_cols: list[str], y_col: str, max_rows: int | None = None,
                    epsilon: float = DEFAULT_EPSILON, clip: float = CLIP_NORM, seed: int = SEED,
                    key_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """H6: the same on unsequenced rows of all splits: all of them, or a hash
    sample of ``max_rows`` per client (E6). Returns the profiles and an error table
    (client_id, error) of the clients without a usable row (no finite target)."""
    from groupcast.operators.split import sample_per_client

    src = rows
    if max_rows is not None:
        src = sample_per_client(rows, max_rows, seed, key_cols or ["client_id", "item_id", "date"])
    seqs = src.select("client_id", F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("x"), F.col(y_col).cast("double").alias("y"))
    good = seqs.filter(F.col("y").isNotNull() & ~F.isnan("y"))
    errors = rows.select("client_id").distinct().join(good.select("client_id").distinct(), "client_id", "left_anti")
    return _profiles(importance_long(row_moments(good)), epsilon, clip, seed), errors.withColumn("error", F.lit("no usable rows"))


def top_features(profiles: DataFrame, col: str = "importance", k: int = 3) -> DataFrame:
    """H7: the k largest values per client, descending (ties by position).
    The window holds one client's vector (its length), never data rows."""
    ex = profiles.select("client_id", F.posexplode(col).alias("pos", "value"))
    w = Window.partitionBy("client_id").orderBy(F.col("value").desc(), F.col("pos").asc())
    return ex.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
