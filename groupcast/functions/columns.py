"""Scalar column helpers. All are built-in expressions (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_POW_32 = 4294967296.0


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 (ANSI mode would raise)."""
    return num / F.nullif(den, F.lit(0.0))


def sign(c: Column) -> Column:
    """-1, 0 or 1 as double (0 at 0, like torch.sign)."""
    return F.signum(c)


def hash_uniform(*parts: Column | str, seed: int) -> Column:
    """Deterministic uniform in (0, 1) from the md5 of the key columns.

    Depends only on the key values and seed, never on partitioning, so a
    re-run (or a retried task) gives the same number. The same expression is
    written in DuckDB SQL as
    ``(('0x' || substr(md5(k1 || '|' || k2 || '|' || seed), 1, 8))::BIGINT + 0.5) / 4294967296``.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(_TWO_POW_32)


def laplace_from_uniform(u: Column, scale: float | Column) -> Column:
    """Laplace(0, scale) by the inverse CDF of a uniform in (0, 1)."""
    scale_c = scale if isinstance(scale, Column) else F.lit(float(scale))
    d = u - F.lit(0.5)
    return -scale_c * F.signum(d) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(d))
