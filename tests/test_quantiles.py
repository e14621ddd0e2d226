"""Exact quantiles against Spark's own percentile, and the key's order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from groupcast.functions.quantiles import exact_quantiles, order_key


def test_key_orders_as_doubles(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, 1 / 3, 2.0**-1022]
    values += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).collect()
    by_key = sorted(got, key=lambda r: r.k)
    assert [r.v for r in by_key] == sorted(values)
    assert {r.k for r in got if r.v == 0} == {next(r.k for r in got if r.v == 0)}


@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.75], [0.0, 1.0, 0.1, 0.999]])
def test_quantiles_equal_percentile(spark, probs):
    rng = random.Random(2)
    rows = [("one", 4.5), ("two", -1.0), ("two", 3.0), ("null", None)]
    rows += [("same", 7.25)] * 50
    rows += [("hot", rng.gauss(0, 1) * 10.0 ** rng.randint(-8, 8)) for _ in range(5000)]  # no value twice
    rows += [("few", float(rng.randint(-3, 3))) for _ in range(999)]
    rows += [("near", 1.0 + k * 2.0**-52) for k in range(100)]  # equal but for their last bits
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {r.g: r.q for r in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    got = {r.g: r.q for r in exact_quantiles(df, "g", "v", probs).collect()}
    assert got == want
