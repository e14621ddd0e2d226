"""The upper tail of the F(1, nu) distribution in DataFrame functions.

P(F > f) = I_x(nu/2, 1/2) with x = nu / (nu + f), a regularised incomplete beta function: a front factor times a
continued fraction, evaluated by the modified Lentz scheme as a fold over its coefficients. Its convergence slows as x
nears 1, by about the square root of nu / f, so the number of coefficients follows from the row. It is called on one
value per feature; the same series is the query's recursive SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TINY = 1e-300
_SHIFT = 12
MAX_DOUBLE = 1.7976931348623157e308


def _guard(v: Column) -> Column:
    return F.when(F.abs(v) > _TINY, v).otherwise(F.lit(_TINY))


def _log_gamma_ratio(a: Column) -> Column:
    """ln(Gamma(a + 1/2) / Gamma(a)): its asymptotic series at a + _SHIFT, and the recurrence back."""
    z = a + F.lit(float(_SHIFT))
    series = F.lit(0.5) * F.log(z) - F.lit(1 / 8) / z + F.lit(1 / 192) / F.pow(z, F.lit(3.0)) - F.lit(1 / 640) / F.pow(z, F.lit(5.0))
    for i in range(_SHIFT):
        series = series - F.log((a + F.lit(i + 0.5)) / (a + F.lit(float(i))))
    return series


def _fraction(p: Column, q: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of I_x(p, q)."""
    one = F.lit(1.0)
    d0 = one / _guard(one - (p + q) * x / (p + one))

    def step(acc, k):
        m = F.floor(k / F.lit(2)).cast("double")
        even = m * (q - m) * x / ((p + F.lit(2.0) * m - one) * (p + F.lit(2.0) * m))
        odd = -(p + m) * (p + q + m) * x / ((p + F.lit(2.0) * m) * (p + F.lit(2.0) * m + one))
        coefficient = F.when(k % 2 == 0, even).otherwise(odd)
        d = one / _guard(one + coefficient * acc["d"])
        c = _guard(one + coefficient / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    start = F.struct(one.alias("c"), d0.alias("d"), d0.alias("h"))
    return F.aggregate(F.sequence(F.lit(2), steps), start, step, lambda acc: acc["h"])


def with_f1_pvalue(df: DataFrame, f: str, nu: str, out: str = "p_value") -> DataFrame:
    """Adds P(F(1, nu) > f); 1 where f or nu is no number, nu is not positive, or f is not positive; 0 for an infinite f."""
    sound = F.col(f).isNotNull() & ~F.isnan(f) & F.col(nu).isNotNull() & ~F.isnan(nu) & (F.col(nu) > 0) & (F.col(nu) < MAX_DOUBLE)
    inner = sound & (F.col(f) > 0) & (F.col(f) < MAX_DOUBLE)
    d = df.withColumns({"_f": F.when(inner, F.col(f).cast("double")), "_nu": F.when(inner, F.col(nu).cast("double"))})
    d = d.withColumns({"_a": F.col("_nu") / 2.0, "_x": F.col("_nu") / (F.col("_nu") + F.col("_f")), "_y": F.col("_f") / (F.col("_nu") + F.col("_f"))})
    # Where x is large the other side's fraction converges, in few steps.
    d = d.withColumn("_near", F.col("_x") < (F.col("_a") + 1.0) / (F.col("_a") + 2.5))
    steps = F.when(F.col("_near"), F.ceil(F.lit(24.0) * F.sqrt(F.col("_nu") / F.col("_f")))).otherwise(F.lit(0)) + F.lit(400)
    half = F.lit(0.5)
    front = F.exp(_log_gamma_ratio(F.col("_a")) - F.lit(0.5 * math.log(math.pi)) - F.col("_a") * F.log1p(F.col("_f") / F.col("_nu")) + half * F.log("_y"))
    d = d.withColumns({"_steps": steps.cast("int"), "_front": front})
    d = d.withColumns({
        "_p": F.when(F.col("_near"), F.col("_a")).otherwise(half), "_q": F.when(F.col("_near"), half).otherwise(F.col("_a")),
        "_z": F.when(F.col("_near"), F.col("_x")).otherwise(F.col("_y")),
    })
    side = F.col("_front") * _fraction(F.col("_p"), F.col("_q"), F.col("_z"), F.col("_steps")) / F.col("_p")
    d = d.withColumn("_side", F.when(F.col("_steps").isNotNull() & F.col("_p").isNotNull(), side))
    p = F.when(F.col("_near"), F.col("_side")).otherwise(F.lit(1.0) - F.col("_side"))
    edge = F.when(sound & (F.col(f) >= MAX_DOUBLE), F.lit(0.0)).otherwise(F.lit(1.0))
    return d.withColumn(out, F.coalesce(F.nanvl(p, F.lit(1.0)), edge)).drop("_f", "_nu", "_a", "_x", "_y", "_near", "_steps", "_front", "_p", "_q", "_z", "_side")
