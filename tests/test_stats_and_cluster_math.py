"""Pure numeric helpers: F-test p-values (goldens) and clustering steps."""

import numpy as np
import pytest

from groupcast.operators import cluster as C

N = 885352  # pooled train rows of the published run

GOLDEN = [
    (39.01268803034379, 4.2125024314136913e-10),
    (34.72004205143218, 3.808290679136098e-09),
    (6.881583965537065, 0.008708984280225934),
    (3.949343455028238, 0.04688996625802882),
    (1.0650447454888787, 0.302067690958726),
    (0.0051795537604718295, 0.9426265018669275),
]


def tails(spark, rows):
    from groupcast.functions.stats import with_f1_pvalue

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f double, nu double")
    return [r.p_value for r in sorted(with_f1_pvalue(df, "f", "nu").collect(), key=lambda r: r.i)]


def test_pvalue_goldens(spark):
    got = tails(spark, [(f, float(N - 2)) for f, _ in GOLDEN])
    assert got == pytest.approx([p for _, p in GOLDEN], rel=1e-8)


def test_pvalue_edges(spark):
    rows = [(0.0, 100.0), (float("nan"), 100.0), (4447361.77, float(N - 2)), (None, 5.0), (2.0, None), (2.0, 0.0), (1.7976931348623157e308, 9.0), (float("inf"), 9.0)]
    assert tails(spark, rows) == [1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0]


def test_pvalue_monotone_in_f(spark):
    ps = tails(spark, [(f, 1000.0) for f in (0.1, 1.0, 3.0, 3.1, 10.0, 50.0)])
    assert all(a > b for a, b in zip(ps, ps[1:]))


def test_pvalue_of_few_and_many_rows(spark):
    """Closed forms: nu = 1 is a Cauchy tail, nu = 2 algebraic; for large nu the normal tail."""
    import math

    fs = [1e-6, 0.01, 0.5, 1.4, 1.6, 4.0, 90.0, 1e6]
    assert tails(spark, [(f, 1.0) for f in fs]) == pytest.approx([1 - 2 / math.pi * math.atan(math.sqrt(f)) for f in fs], rel=1e-9, abs=1e-13)
    assert tails(spark, [(f, 2.0) for f in fs]) == pytest.approx([1 - math.sqrt(f / (f + 2)) for f in fs], rel=1e-6, abs=1e-13)
    assert tails(spark, [(f, 1e9) for f in (0.01, 0.5, 2.0, 30.0)]) == pytest.approx([math.erfc(math.sqrt(f / 2)) for f in (0.01, 0.5, 2.0, 30.0)], rel=1e-5)


def test_k_range(spark):
    clients = spark.createDataFrame([("s3", f"c{i}") for i in range(3)] + [("s70", f"c{i:02d}") for i in range(70)], "scope string, client_id string")
    none = spark.createDataFrame([], "scope string, a string, b string, height double, round int, rank int")

    def ks(most):
        got = {}
        for r in C.candidate_labels(clients, none, 0, most).select("scope", "k").distinct().collect():
            got.setdefault(r.scope, []).append(r.k)
        return {s: sorted(v) for s, v in got.items()}

    assert ks(None) == {"s3": [2], "s70": list(range(2, 10))}
    assert ks(15) == {"s3": [2], "s70": list(range(2, 16))}
