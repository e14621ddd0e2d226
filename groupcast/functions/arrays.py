"""Array expressions built from Spark higher-order functions (no UDFs).

Rule followed throughout: a lambda body references only its own lambda
variables. Catalyst may inline a single-use outer expression into the lambda,
where it would be evaluated once per *element*; outer scalars are therefore
brought in as ``array_repeat(scalar, n)`` and combined with ``zip_with``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(arr: Column | str) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x)


def array_l2_norm(arr: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x * x))


def scale_by(arr: Column | str, factor: Column) -> Column:
    """Element-wise arr * factor with factor evaluated once per row."""
    a = _c(arr)
    return F.zip_with(a, F.array_repeat(factor, F.size(a)), lambda x, f: x * f)


def clip_l2(arr: Column | str, clip: float) -> Column:
    """Scale by clip/||v|| when ||v|| > clip, else unchanged."""
    a = _c(arr)
    norm = array_l2_norm(a)
    factor = F.when(norm > F.lit(clip), F.lit(clip) / norm).otherwise(F.lit(1.0))
    return scale_by(a, factor)


def normalise_distribution(arr: Column | str) -> Column:
    """max(v, 0) / sum; uniform 1/d when the positive sum is 0."""
    a = _c(arr)
    pos = F.transform(a, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    total = array_sum(pos)
    n = F.size(a)
    return F.when(total > F.lit(0.0), scale_by(pos, F.lit(1.0) / total)).otherwise(
        F.array_repeat(F.lit(1.0) / n.cast("double"), n)
    )


def array_cdf(arr: Column | str) -> Column:
    """Running sum: cdf[i] = v[0] + ... + v[i]."""
    a = _c(arr)
    init = F.struct(F.array().cast("array<double>").alias("c"), F.lit(0.0).alias("s"))
    return F.aggregate(
        a, init,
        lambda acc, x: F.struct(F.concat(acc["c"], F.array(acc["s"] + x)).alias("c"), (acc["s"] + x).alias("s")),
        lambda acc: acc["c"],
    )


def array_l1(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x
    )


def ema_combine(old: Column | str, new: Column | str, alpha: float) -> Column:
    """alpha*old + (1-alpha)*new when both exist with equal length, else new."""
    o, n = _c(old), _c(new)
    mixed = F.zip_with(o, n, lambda x, y: F.lit(alpha) * x + F.lit(1.0 - alpha) * y)
    return F.when(o.isNotNull() & (F.size(o) == F.size(n)), mixed).otherwise(n)
