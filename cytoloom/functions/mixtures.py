"""Mixtures of two normal distributions for many features at once, by expectation maximisation over counts of equal values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoloom.lineage import materialize


FIELDS = ["share1", "mean1", "sd1", "share2", "mean2", "sd2"]


def _log_density(which: int) -> Column:
    m, s, w = (F.col(f"{c}{which}") for c in ("mean", "sd", "share"))
    return F.log(w) - F.log(s) - F.pow((F.col("v") - m) / s, F.lit(2.0)) / 2 - 0.5 * math.log(2 * math.pi)


def _weighed(counts: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """counts with the logarithm of each value's density and the share of the higher component in it.

    A model has one row per group, so it is broadcast: joined by the keys, all values of a group would be sorted in one task.
    """
    top = F.greatest("l1", "l2")
    both = counts.join(F.broadcast(model), keys).withColumns({"l1": _log_density(1), "l2": _log_density(2)})
    both = both.withColumn("log", top + F.log(F.exp(F.col("l1") - top) + F.exp(F.col("l2") - top)))
    return both.withColumn("high", F.exp(F.col("l2") - F.col("log")))


def _step(counts: DataFrame, state: DataFrame, keys: list[str], tolerance: float, floor: float) -> DataFrame:
    """state (keys, rows, spread, FIELDS, likelihood, round, done) after one round; groups that are done stay as they are."""
    n, v = F.col("n"), F.col("v")
    seen = _weighed(counts, state.withColumnRenamed("likelihood", "before"), keys)
    parts = [(1, n * (1 - F.col("high"))), (2, n * F.col("high"))]
    sums = seen.groupBy(*keys, "rows", "spread", "before", "round", "done", *FIELDS).agg(
        F.sum(n * F.col("log")).alias("likelihood"),
        *[x for j, w in parts for x in (F.sum(w).alias(f"w{j}"), F.sum(w * v).alias(f"x{j}"))],
        *[F.sum(w * F.pow(v - F.col(f"mean{j}"), F.lit(2.0))).alias(f"y{j}") for j, w in parts],
    )
    new = {}
    for j in (1, 2):
        w = F.greatest(f"w{j}", F.lit(1e-12))
        mean = F.col(f"x{j}") / w
        new |= {f"share{j}": F.greatest(w / F.col("rows"), F.lit(1e-12)), f"mean{j}": mean}
        new[f"sd{j}"] = F.greatest(F.sqrt(F.greatest(F.col(f"y{j}") / w - F.pow(mean - F.col(f"mean{j}"), F.lit(2.0)), F.lit(0.0))), F.col("spread") * floor)
    done = F.col("done") | (F.col("likelihood") - F.col("before") <= tolerance * F.col("rows"))
    stay = lambda old, other: F.when(F.col("done"), F.col(old)).otherwise(other)
    return sums.select(
        *keys, "rows", "spread", *[F.when(done, F.col(c)).otherwise(new[c]).alias(c) for c in FIELDS],
        stay("before", F.col("likelihood")).alias("likelihood"), stay("round", F.col("round") + 1).alias("round"), done.alias("done"),
    )


def two_normals(df: DataFrame, keys: list[str], value: str, rounds: int = 50, tolerance: float = 1e-6, floor: float = 1e-3) -> DataFrame:
    """(keys, share1, mean1, sd1, share2, mean2, sd2, likelihood, round): component 2 has the larger mean; one row per group.

    All groups are fitted together, some rounds in one job; equal values are counted first. It starts from the halves below and above the mean. A
    deviation never falls below ``floor`` of the whole one. Groups that gain less than ``tolerance`` per row are done; ``round`` tells the last.
    A group of equal values has share2 0. Nulls and NaN don't count.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = materialize(rows.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    n, v = F.col("n"), F.col("v")
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), (F.sum(n * v) / F.sum("n")).alias("middle"))
    spread = counts.join(F.broadcast(whole), keys).groupBy(*keys, "rows", "middle").agg(F.sqrt(F.sum(n * F.pow(v - F.col("middle"), F.lit(2.0))) / F.first("rows")).alias("spread"))
    sides = counts.join(F.broadcast(spread), keys).groupBy(*keys, "rows", "spread").agg(
        *[x for k, side in ((1, v <= F.col("middle")), (2, v > F.col("middle"))) for x in (
            (F.sum(F.when(side, n).otherwise(0)) / F.first("rows")).alias(f"share{k}"),
            F.coalesce(F.sum(F.when(side, n * v)) / F.sum(F.when(side, n)), F.first("middle")).alias(f"mean{k}"),
        )]
    )
    start = F.greatest(F.col("spread") / 2, F.lit(1e-300))
    state = sides.withColumns({"sd1": start, "sd2": start, "likelihood": F.lit(float("-inf")), "round": F.lit(0), "done": F.col("share2") == 0})
    state = materialize(state.select(*keys, "rows", "spread", *FIELDS, "likelihood", "round", "done"))
    out, going = state.where("done"), state.where("NOT done")
    for k in range(1, rounds + 1):
        going = _step(counts, going, keys, tolerance, floor)
        if k % 5 and k < rounds:
            continue  # a few rounds make one job
        state = materialize(going)
        out = out.unionByName(state.where("true" if k == rounds else "done"))
        going = state.where("NOT done")
        if going.isEmpty():
            break
    swap = F.col("mean1") > F.col("mean2")
    ordered = [F.when(swap & (F.col("share2") > 0), F.col(c[:-1] + ("2" if c[-1] == "1" else "1"))).otherwise(F.col(c)).alias(c) for c in FIELDS]
    return out.select(*keys, *ordered, F.when(F.col("share2") > 0, F.col("likelihood")).alias("likelihood"), "round")


def high_share(df: DataFrame, model: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with high: the share of the component with the larger mean at the row's value; 0 where a group has no second one."""
    two = model.select(*keys, *FIELDS).where("share2 > 0")
    high = _weighed(df.withColumn("v", F.col(value).cast("double")), two, keys).drop("v", "l1", "l2", "log", *FIELDS)
    rest = df.join(two.select(*keys), keys, "left_anti").withColumn("high", F.lit(0.0))
    return high.unionByName(rest)
