"""Parameters of the two-part linear forecaster.

prediction (scaled) = head.a * <body.w, flatten(x_seq)> + head.b

``body.*`` is shared between clients (averaged), ``head.*`` is personal.
A parameter table has one row per owner: owner_id, body (array), a, b,
plus an optional ``n`` (train samples) used as the averaging weight.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupcast.constants import BODY_PREFIX, HEAD_PREFIX, SEED
from groupcast.functions.columns import hash_uniform

OWNER = "client_id"


def init_params(owners: DataFrame, dim: int, seed: int = SEED) -> DataFrame:
    """Seeded start per owner: body ~ U(-1/sqrt(dim), 1/sqrt(dim)),
    head a, b ~ U(-1, 1) (fan-in 1), from md5(owner | layer | pos | seed).

    Built in long form (one scalar hash per owner and position), then
    gathered per owner, so every hash is computed exactly once."""
    r = 1.0 / math.sqrt(dim)
    pos = owners.select(OWNER, F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("pos"))
    w = (F.lit(2.0) * hash_uniform(F.col(OWNER), F.lit("body.w"), F.col("pos"), seed=seed) - F.lit(1.0)) * F.lit(r)
    body = pos.select(OWNER, "pos", w.alias("w")).groupBy(OWNER).agg(
        F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("_s")
    ).select(OWNER, F.transform("_s", lambda s: s["w"]).alias("body"))
    a = F.lit(2.0) * hash_uniform(F.col(OWNER), F.lit("head.a"), F.lit(0), seed=seed) - F.lit(1.0)
    b = F.lit(2.0) * hash_uniform(F.col(OWNER), F.lit("head.b"), F.lit(0), seed=seed) - F.lit(1.0)
    return body.join(owners.select(OWNER, a.alias("a"), b.alias("b")), OWNER)


def params_table(params: DataFrame) -> DataFrame:
    """Long view (owner, layer, pos, value) in parameter order."""
    body = params.select(OWNER, F.lit("body.w").alias("layer"), F.posexplode("body").alias("pos", "value"))
    head = params.select(
        OWNER, F.explode(F.array(
            F.struct(F.lit("head.a").alias("layer"), F.lit(0).alias("pos"), F.col("a").alias("value")),
            F.struct(F.lit("head.b").alias("layer"), F.lit(0).alias("pos"), F.col("b").alias("value")),
        )).alias("s"),
    ).select(OWNER, "s.layer", "s.pos", "s.value")
    return body.unionByName(head)


def select_layers(long: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Parameters whose layer name starts with one of the prefixes."""
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col("layer").startswith(p)
    return long.filter(cond)


def shared_part(long: DataFrame) -> DataFrame:
    return select_layers(long, (BODY_PREFIX,))


def head_part(long: DataFrame) -> DataFrame:
    return select_layers(long, (HEAD_PREFIX,))


def overlay_params(current: DataFrame, new: DataFrame, shared_only: bool = True) -> DataFrame:
    """Replace the body (or everything) of each owner by ``new``'s,
    keep the rest. ``new`` is keyed by owner (already sent to owners)."""
    if shared_only:
        n = new.select(OWNER, F.col("body").alias("_nb"))
        return current.join(n, OWNER, "left").withColumn("body", F.coalesce("_nb", "body")).drop("_nb")
    n = new.select(OWNER, F.col("body").alias("_nb"), F.col("a").alias("_na"), F.col("b").alias("_nbb"))
    return (
        current.join(n, OWNER, "left")
        .withColumn("body", F.coalesce("_nb", "body"))
        .withColumn("a", F.coalesce("_na", "a"))
        .withColumn("b", F.coalesce("_nbb", "b"))
        .drop("_nb", "_na", "_nbb")
    )


def send_params(assign: DataFrame, group_params: DataFrame, group_col: str = "bubble") -> DataFrame:
    """Give every owner its group's parameters (equi-join on group)."""
    return assign.select(OWNER, group_col).join(group_params.drop("n"), group_col).drop(group_col)


def average_params(params: DataFrame, group_col: str = "bubble", weight: str = "n", with_head: bool = True) -> DataFrame:
    """K7: sum(w * n) / sum(n) per group, layer and position.

    One weighted vector mean per group (MLlib Summarizer with a weight
    column): partial-aggregated, no per-element rows."""
    parts = [F.col("body")] + ([F.array(F.col("a"), F.col("b"))] if with_head else [])
    vec = array_to_vector(F.concat(*parts))
    agg = params.groupBy(group_col).agg(
        vector_to_array(Summarizer.mean(vec, F.col(weight).cast("double"))).alias("_m"),
        F.max(F.size("body")).alias("_d"),
        F.sum(weight).cast("long").alias("n"),
    )
    out = agg.select(group_col, F.slice("_m", 1, F.col("_d")).alias("body"), "n",
                     *( [F.col("_m")[F.col("_d")].alias("a"), F.col("_m")[F.col("_d") + 1].alias("b")] if with_head else []))
    return out


def first_owner_params(params: DataFrame) -> DataFrame:
    """Start of warm-up / averaged training: the first owner's parameters
    (lowest id), as the original starts from its first client."""
    first = params.agg(F.min(OWNER).alias(OWNER))
    return params.join(first, OWNER)
