"""Exact percentiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytoloom.lineage import materialize


def placed_values(counts: DataFrame, keys: list[str], ranges: int = 256) -> DataFrame:
    """counts (keys, v, n), one row per value, with below: how many rows of the group have a smaller value. In two levels: ranges, then inside a range.

    Ranges end at approximate quantiles of the group's distinct values, so each holds about as many of them, however skewed they are. Approximate
    quantiles of large groups depend on the order in which parts of them arrive, and the ranges are read twice, so they are written first.
    """
    step = round(ranges**0.5)
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 50 * ranges).alias("_cuts"))
    cuts = materialize(cuts.withColumn("_some", F.filter("_cuts", lambda _, k: k % step == step - 1)))
    counts = counts.join(cuts, keys) if keys else counts.crossJoin(F.broadcast(cuts))  # one row
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col("v")))
    counts = counts.withColumn("_from", step * below("_some"))
    counts = counts.withColumn("_part", F.col("_from") + below(F.slice("_cuts", F.col("_from") + 1, step))).drop("_cuts", "_some", "_from")
    sums = counts.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("n").over(W.partitionBy(*keys, "_part").orderBy("v").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [*keys, "_part"])
    return counts.withColumn("below", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_part")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per name): exact percentiles with linear interpolation; nulls don't count, groups without values are left out.

    Equal values are counted together with map-side combine, and a value's place comes from sums by ranges, so that a task sorts one range
    of a group's distinct values, not all.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = placed_values(counts, keys)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    placed = placed.join(total, keys) if keys else placed.crossJoin(F.broadcast(total))  # one row
    spot = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    holds = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
    ends = [(F.floor(spot(q)), F.ceil(spot(q))) for q in shares.values()]
    near = placed.where(reduce(Column.__or__, [holds(e) for pair in ends for e in pair]))

    def between(q: float, low: Column, high: Column) -> Column:
        a, b = F.max(F.when(holds(low), F.col("v"))), F.max(F.when(holds(high), F.col("v")))
        at = F.max(spot(q))
        return a + (b - a) * (at - F.floor(at))

    return near.groupBy(*keys).agg(*[between(q, *pair).alias(name) for (name, q), pair in zip(shares.items(), ends)])
