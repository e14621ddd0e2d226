"""Exact quantiles per group in bounded memory, by refining prefixes of an order-preserving key.

A double's bits, with all but the sign flipped for negatives, order as the doubles do. Four passes count
the rows per 16 more bits of that key, each pass only under the prefixes that hold a wanted rank, so a group has
at most 65,536 counts per prefix in any pass, however many distinct values it has, and rows are never sorted or
shuffled: counts are combined where the rows lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 16


def order_key(value: Column) -> Column:
    """A long that orders as the double does; -0.0 counts as 0.0."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))


def exact_quantiles(rows: DataFrame, group: str, value: str, probs: list[float]) -> DataFrame:
    """Per group the quantiles of ``value`` with linear interpolation: group, q (an array in the order of probs).
    Rows without a value do not count; a group without values is absent."""
    keyed = rows.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v")).withColumn("_key", order_key(F.col("_v")))
    found = None
    for shift in (48, 32, 16, 0):
        last = shift == 0
        part = F.shiftright("_key", shift).alias("_part")
        worth = [F.max("_v").alias("_value")] if last else []
        if found is None:
            counts = keyed.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"), *worth)
            up = Window.partitionBy(group).orderBy("_part")
            ranked = counts.withColumns({"_to": F.sum("_n").over(up), "_total": F.sum("_n").over(Window.partitionBy(group))})
            at = F.col("_p") * (F.col("_total") - 1)
            wanted = F.explode(F.array(*[
                F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.lit(float(p)).alias("p"))
                for i, p in enumerate(probs) for side in ("low", "high")]))
            ranks = ranked.withColumn("_w", wanted).withColumn("_p", F.col("_w.p")).withColumn(
                "_rank", F.when(F.col("_w.side") == "low", F.floor(at)).otherwise(F.ceil(at)))
            hit = ranks.filter((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_n")))
            found = hit.select(group, F.col("_w.i").alias("_i"), F.col("_w.side").alias("_side"), at.alias("_at"),
                               (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"), F.col("_part").alias("_prefix"))
            continue
        prefixes = found.select(group, "_prefix").distinct()
        under = keyed.withColumn("_prefix", F.shiftright("_key", shift + STEP)).join(prefixes, [group, "_prefix"])
        counts = under.groupBy(group, "_prefix", part).agg(F.count(F.lit(1)).alias("_n"), *worth)
        up = Window.partitionBy(group, "_prefix").orderBy("_part")
        ranked = counts.withColumn("_to", F.sum("_n").over(up))
        hit = found.join(ranked, [group, "_prefix"]).filter((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_n")))
        found = hit.select(group, "_i", "_side", "_at", (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_rank"),
                           F.col("_part").alias("_prefix"), *(["_value"] if last else []))
    ends = found.groupBy(group, "_i").agg(
        F.max("_at").alias("at"), F.max(F.when(F.col("_side") == "low", F.col("_value"))).alias("low"),
        F.max(F.when(F.col("_side") == "high", F.col("_value"))).alias("high"))
    low, high, at = F.col("low"), F.col("high"), F.col("at")
    between = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    return ends.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_i", between.alias("v")))).alias("_q")).select(
        group, F.transform("_q", lambda s: s["v"]).alias("q"))
