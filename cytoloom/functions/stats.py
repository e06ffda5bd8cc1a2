"""Statistical tests over DataFrames.

Sums, ranks and statistics are made by Spark; only probabilities of a statistic, one row per test, come from vectorised Python.
Values are ranked in two levels (ranges of value, then inside a range), so that no feature is sorted whole by one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cytoloom.lineage import materialize

from .draws import first_by_hash
from .percentiles import placed_values

TINY = 1e-300
DOUBLE = T.DoubleType()


def _over(values: pd.Series, f) -> pd.Series:
    return pd.Series([None if v is None or v != v else f(v) for v in values], dtype="float64")


@F.pandas_udf(DOUBLE)
def two_sided_normal(z: pd.Series) -> pd.Series:
    """The probability of a standard normal value at least as far from 0."""
    return _over(z, lambda v: math.erfc(abs(v) / math.sqrt(2)))


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or TINY)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / ((1 + step * d) or TINY)
            c = (1 + step / c) or TINY
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


@F.pandas_udf(DOUBLE)
def two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v or not n > 0 else beta_fraction(n / 2, 0.5, n / (n + v * v)) for v, n in zip(t, df)], dtype="float64")


@F.pandas_udf(DOUBLE)
def upper_f(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v or not b > 0 else beta_fraction(b / 2, a / 2, b / (b + a * v)) for v, a, b in zip(f, df1, df2)], dtype="float64")


def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """The number of arrangements of n1 and n2 untied values with each value of U."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for k in range(1, n1 + 1):  # the generating function is a product of (1 - q^(n2 + k)) / (1 - q^k)
        up = n2 + k
        if up < len(ways):
            ways[up:] = ways[up:] - ways[:-up]
        for at in range(k, len(ways)):
            ways[at] += ways[at - k]
    return ways


@F.pandas_udf(DOUBLE)
def exact_rank_sum(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """The two-sided exact probability of U without ties."""

    def one(u, a, b):
        ways = rank_sum_counts(int(a), int(b))
        low = ways[: int(u) + 1].sum() if u <= a * b / 2 else ways[int(u) :].sum()
        return min(1.0, 2 * low / ways.sum())

    return pd.Series([None if x != x else one(x, a, b) for x, a, b in zip(u, n1, n2)], dtype="float64")


@F.pandas_udf(DOUBLE)
def upper_hypergeometric(hits: pd.Series, white: pd.Series, total: pd.Series, draws: pd.Series) -> pd.Series:
    """The probability of at least so many white ones among the draws without replacement.

    Terms follow from each other by their ratio, outwards from the largest one of the tail, so the time grows with the deviation of the number of
    white ones, not with the draws.
    """

    def choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def terms(k, end, step, ratio):
        """The terms after k over that of k, until the next would change nothing."""
        term, out = 1.0, 0.0
        while k != end:
            term *= ratio(k)
            if term < 1e-17 * (1 + out):
                break
            out += term
            k += step
        return out

    def one(c, w, n, d):
        low, high = int(max(c, 0, d - (n - w))), int(min(w, d))
        if low > high:
            return 0.0
        if low == max(0, d - (n - w)):
            return 1.0
        k = min(max(low, int((w + 1) * (d + 1) / (n + 2))), high)  # the largest term of the tail
        up = terms(k, high, 1, lambda j: (w - j) * (d - j) / ((j + 1) * (n - w - d + j + 1)))
        down = terms(k, low, -1, lambda j: j * (n - w - d + j) / ((w - j + 1) * (d - j + 1)))
        return min(1.0, math.exp(choose(w, k) + choose(n - w, d - k) - choose(n, d)) * (1 + up + down))

    return pd.Series([one(*x) for x in zip(hits, white, total, draws)], dtype="float64")


def bh_adjust(tests: DataFrame, p: str = "p", keys: tuple[str, ...] = (), out: str = "p_adj") -> DataFrame:
    """tests with Benjamini-Hochberg adjusted probabilities, over all tests of the keys; null ones stay null. One row per test."""
    every = W.partitionBy(*keys)
    down = every.orderBy(F.desc_nulls_last(p))
    tests = tests.withColumn("_n", F.count(p).over(every)).withColumn("_rank", F.col("_n") - F.row_number().over(down) + 1)
    scaled = F.when(F.col(p).isNotNull(), F.col(p) * F.col("_n") / F.col("_rank"))
    least = F.min(scaled).over(down.rowsBetween(W.unboundedPreceding, 0))
    return tests.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_n", "_rank")


def value_ranks(rows: DataFrame, keys: list[str], value: str, ranges: int = 256) -> DataFrame:
    """(keys, value, ones, twos, below): distinct values with the rows of both groups, and how many rows have a smaller value.

    rows have a boolean column ``one``. Equal values are counted together before anything is ordered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count_if("one").alias("ones"), F.count_if(~F.col("one")).alias("twos"))
    placed = placed_values(counts.withColumn("n", F.col("ones") + F.col("twos")), keys, ranges)
    return placed.select(*keys, F.col("v").alias(value), "ones", "twos", "below")


def rank_sum(rows: DataFrame, one: Column, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n1, n2, u, z, p): the two-sided rank-sum test of the rows where ``one`` holds against the others, with average ranks.

    Exact where both groups have fewer than 50 rows and no values tie; else the normal approximation with continuity correction.
    Features of one value only have z 0 and p 1.
    """
    ranks = value_ranks(rows.withColumn("one", F.coalesce(one, F.lit(False))), keys, value)
    n = F.col("ones") + F.col("twos")
    sums = ranks.groupBy(*keys).agg(
        F.sum("ones").alias("n1"), F.sum("twos").alias("n2"),
        F.sum(F.col("ones") * (F.col("below") + (n + 1) / 2)).alias("r1"),
        F.sum(n.cast("double") * n * n - n).alias("ties"),
    )
    n1 = F.col("n1").cast("double")
    return _rank_sum_tests(sums.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2), keys)


def _rank_sum_tests(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n1, n2, u, z, p) of (keys, n1, n2, u, ties)."""
    n1, n2, both = F.col("n1").cast("double"), F.col("n2").cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    away = F.col("u") - n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * (both + 1 - F.col("ties") / (both * (both - 1))))
    sums = sums.withColumn("z", F.when(spread > 0, (away - 0.5 * F.signum(away)) / spread).otherwise(0.0))
    exact = (n1 < 50) & (n2 < 50) & (F.col("ties") == 0) & (n1 > 0) & (n2 > 0)
    sums = sums.withColumn("_u", F.when(exact, F.col("u"))).withColumn("_exact", exact)
    p = F.when(F.col("_exact"), exact_rank_sum("_u", "n1", "n2")).otherwise(two_sided_normal("z"))
    return sums.select(*keys, "n1", "n2", "u", "z", p.alias("p"))


def differential_expression(expr: DataFrame, cells: DataFrame, one: Column, two: Column, least: int = 3) -> DataFrame:
    """(feature, n1, n2, u, z, p, p_adj, log2fc, pct1, pct2) of two groups of cells, for every feature of the long table expr.

    one and two are conditions on cells. Raises ValueError if a group has fewer than ``least`` cells.
    """
    groups = cells.select("cell_id", F.when(one, True).when(two, False).alias("one")).where("one IS NOT NULL")
    sizes = groups.agg(F.count_if("one").alias("a"), F.count_if(~F.col("one")).alias("b")).first()
    if min(sizes["a"], sizes["b"]) < least:
        raise ValueError(f"a group has fewer than {least} cells")
    rows = expr.select("cell_id", "feature", "value").join(groups, "cell_id")
    test = rank_sum(rows, F.col("one"), ["feature"])
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("value"))), F.lit(0.0))
    positive = lambda c: F.coalesce(F.avg(F.when(c, (F.col("value") > 0).cast("double"))), F.lit(0.0))
    both = F.col("one"), ~F.col("one")
    means = rows.groupBy("feature").agg(mean(both[0]).alias("m1"), mean(both[1]).alias("m2"), positive(both[0]).alias("pct1"), positive(both[1]).alias("pct2"))
    found = bh_adjust(test.join(means, "feature"))
    return found.withColumn("log2fc", F.log2((F.col("m1") + 1e-9) / (F.col("m2") + 1e-9))).drop("m1", "m2")


def regulated(tests: DataFrame, alpha: float = 0.05, fold: float = 0.25, out: str = "regulation") -> DataFrame:
    """tests with Up, Down or NS by adjusted probability and log fold change; undefined ones are NS."""
    low = F.col("p_adj") < alpha
    return tests.withColumn(out, F.when(low & (F.col("log2fc") > fold), "Up").when(low & (F.col("log2fc") < -fold), "Down").otherwise("NS"))


def top_markers(tests: DataFrame, n: int = 5, by: str = "celltype", order: str = "log2fc") -> DataFrame:
    """The n rows of each cluster with the greatest order, ties of the last kept."""
    return tests.withColumn("_rank", F.rank().over(W.partitionBy(by).orderBy(F.desc_nulls_last(order)))).where(F.col("_rank") <= n).drop("_rank")


def morans_i(edges: DataFrame, expr: DataFrame, compat: bool = False) -> DataFrame:
    """(feature, i, z, p, p_adj) over the edges (src, dst, dist), weighted by 1 / (dist + 1e-6).

    Standard: n / W times the weighted sum of products of both ends' centred values over the sum of squares. compat leaves out the
    value of the first end, as some tools do. z is (I + 1 / (n - 1)) over 0.5 / sqrt(n) in both forms. Constant features have I 0, p 1.
    """
    weighted = edges.select("src", "dst", (1 / (F.col("dist") + 1e-6)).alias("w"))
    stats = expr.groupBy("feature").agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.var_pop("value").alias("var"))
    stats = stats.withColumn("ss", F.col("var") * F.col("n"))
    centred = expr.join(stats.select("feature", "m"), "feature").select("cell_id", "feature", (F.col("value") - F.col("m")).alias("x"))
    total = weighted.agg(F.sum("w").alias("w_all"))
    if compat:
        into = weighted.groupBy(F.col("dst").alias("cell_id")).agg(F.sum("w").alias("w"))
        sums = centred.join(into, "cell_id").groupBy("feature").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    else:
        ends = weighted.join(centred.select(F.col("cell_id").alias("dst"), "feature", F.col("x").alias("xj")), "dst")
        lag = ends.groupBy(F.col("src").alias("cell_id"), "feature").agg(F.sum(F.col("w") * F.col("xj")).alias("lag"))
        sums = centred.join(lag, ["cell_id", "feature"]).groupBy("feature").agg(F.sum(F.col("x") * F.col("lag")).alias("s"))
    out = stats.join(sums, "feature", "left").crossJoin(F.broadcast(total))  # one row
    flat = F.col("ss") < 1e-15
    i = F.when(flat, 0.0).otherwise(F.col("n") / F.col("w_all") * F.coalesce("s", F.lit(0.0)) / F.col("ss"))
    out = out.withColumn("i", i)
    z = (F.col("i") + 1 / (F.col("n") - 1)) / (0.5 / F.sqrt("n"))
    out = out.withColumn("z", z)
    out = out.withColumn("p", F.when(flat, 1.0).otherwise(two_sided_normal("z")))
    return bh_adjust(out.select("feature", "i", "z", "p"))


def compare_groups(rows: DataFrame, group: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, groups, t, f, df1, df2, p): Welch's t test for two groups, one-way analysis of variance for more.

    t is null but for two groups, f is null for two; p is null where a variance is undefined or zero.
    """
    each = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    part = F.col("v") / F.col("n")
    signed = F.row_number().over(W.partitionBy(*keys).orderBy(group))
    each = each.withColumn("_k", signed)
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("m"))
    sums = each.groupBy(*keys).agg(
        F.count("*").alias("groups"), n.alias("n"), (total / n).alias("grand"),
        F.sum(part).alias("se2"), F.sum(part * part / (F.col("n") - 1)).alias("down"),
        F.sum(F.when(F.col("_k") == 1, F.col("m")).otherwise(-F.col("m"))).alias("diff"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"),
    )
    between = F.col("sq") - F.col("n") * F.col("grand") * F.col("grand")
    two = F.col("groups") == 2
    out = sums.withColumn("t", F.when(two & (F.col("se2") > 0), F.col("diff") / F.sqrt("se2")))
    out = out.withColumn("df1", F.when(two, F.lit(1.0)).otherwise(F.col("groups") - 1.0))
    out = out.withColumn("df2", F.when(two & (F.col("down") > 0), F.col("se2") * F.col("se2") / F.col("down")).when(~two, (F.col("n") - F.col("groups")).cast("double")))
    f = F.when((F.col("groups") > 2) & (F.col("within") > 0) & (F.col("df2") > 0), (between / F.col("df1")) / (F.col("within") / F.col("df2")))
    out = out.withColumn("f", f)
    p = F.when(two, two_sided_t("t", "df2")).otherwise(upper_f("f", "df1", "df2"))
    return out.select(*keys, "groups", "t", "f", "df1", "df2", p.alias("p"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def rank_sum_against_first(rows: DataFrame, group: str, first, value: str = "value") -> DataFrame:
    """(group, n1, n2, u, z, p, stars): each group against the first one.

    The first group's values are placed once: a group's statistic follows from how many of them are below and at each of its values, and its ties
    from those of the first group and what its own values add.
    """
    counts = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    is_first = F.col(group) == F.lit(first)
    base = placed_values(counts.groupBy("v").agg(F.coalesce(F.sum(F.when(is_first, F.col("n"))), F.lit(0)).alias("n")), [])
    cubes = lambda n: n.cast("double") * n * n - n
    whole = base.agg(F.sum("n").alias("n1"), F.sum(cubes(F.col("n"))).alias("own_ties"))
    found = counts.where(~is_first).join(base.select("v", F.col("n").alias("b"), "below"), "v")
    n, b = F.col("n"), F.col("b")
    sums = found.groupBy(group).agg(F.sum("n").alias("n2"), F.sum(n * (F.col("below") + b / 2)).alias("over"), F.sum(cubes(n + b) - cubes(b)).alias("more_ties"))
    sums = sums.crossJoin(F.broadcast(whole)).where("n1 > 0")  # one row
    sums = sums.withColumns({"u": F.col("n1").cast("double") * F.col("n2") - F.col("over"), "ties": F.col("own_ties") + F.col("more_ties")})
    return _rank_sum_tests(sums, [group]).withColumn("stars", stars(F.col("p")))


def contact_enrichment(table: DataFrame) -> DataFrame:
    """table (of contact_table()) with p_out and p_in: the chance of as many touching cells, or more, of the query type among as many
    draws from all cells as the reference has cells, and the same with the types' parts exchanged."""
    out = table.withColumn("p_out", upper_hypergeometric("query_cells", "n_query", "n", "n_ref"))
    return out.withColumn("p_in", upper_hypergeometric("ref_cells", "n_ref", "n", "n_query"))


def minus_log10(tests: DataFrame, p: str = "p", keys: tuple[str, ...] = (), out: str = "minus_log10") -> DataFrame:
    """tests with -log10 p; where p is 0, the 99th percentile of the finite values. One row per test."""
    finite = F.when(F.col(p) > 0, -F.log10(p))
    high = F.percentile(finite, F.lit(0.99)).over(W.partitionBy(*keys))
    return tests.withColumn(out, F.when(F.col(p) == 0, high).otherwise(finite))


def ks_greater(rows: DataFrame, one: Column, keys: list[str], value: str) -> DataFrame:
    """(keys, d): the largest excess of the distribution of the rows where ``one`` holds over that of the others."""
    ranks = value_ranks(rows.withColumn("one", F.coalesce(one, F.lit(False))), keys, value)
    by = W.partitionBy(*keys)
    upto = by.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    share = lambda c: F.sum(c).over(upto) / F.sum(c).over(by)
    return ranks.withColumn("_d", share("ones") - share("twos")).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("_d")).alias("d"))


def distance_effect(cells: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """(ref, query, d): how much nearer the query type's cells are to the reference's than random cells are, as a KS statistic.

    Distances are between draws of n cells of each type at most and, for comparison, n cells of the whole table; cells and their
    own copies (distance 0 to themselves) are left out. The size of the draw is a parameter of the statistic. Draws are written first: they are
    small, which no guess from the size of all cells tells, and a product of unwritten ones has the square of their partitions as tasks.
    """
    point = lambda df, tag: df.select(*(["celltype"] if tag else []), F.col("cell_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    cells = cells.select("cell_id", "celltype", "x", "y")
    own = materialize(first_by_hash(cells, ["celltype"], n, "cell_id", seed))
    ref = own.select(F.col("celltype").alias("ref"), F.col("cell_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    anyone = materialize(first_by_hash(cells.withColumn("_all", F.lit(1)), ["_all"], n, "cell_id", seed + 1).drop("_all"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    near = ref.crossJoin(F.broadcast(point(own, True))).where("src <> dst").select("ref", F.col("celltype").alias("query"), d.alias("dist"), F.lit(True).alias("_one"))  # draws only
    types = own.select(F.col("celltype").alias("query")).distinct()
    far = ref.crossJoin(F.broadcast(point(anyone, False))).where("src <> dst").select("ref", d.alias("dist")).crossJoin(F.broadcast(types)).select("ref", "query", "dist", F.lit(False).alias("_one"))
    return ks_greater(near.unionByName(far), F.col("_one"), ["ref", "query"], "dist")


def bootstrap_median(rows: DataFrame, keys: list[str], value: str = "value", draws: int = 100, seed: int = 42, low: float = 0.025, high: float = 0.975, most: int = 100_000) -> DataFrame:
    """(keys, low, middle, high): percentiles of the medians of resampled values, and the median.

    Meant for groups of samples, which are held whole: a group of more than ``most`` values raises an error. Draws are by the md5 sum of seed, keys,
    draw and place, so reruns agree.
    """
    lists = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_v"))
    lists = lists.withColumn("_v", F.when(F.size("_v") > most, F.raise_error(F.lit(f"a group has more than {most} values"))).otherwise(F.col("_v")))
    lists = lists.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    place = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("_b").cast("string"), i.cast("string"))), 1, 13), 16, 10).cast("long")
    pick = lambda i: F.get("_v", (place(i) % F.size("_v")).cast("int"))
    drawn_values = F.sort_array(F.transform(F.sequence(F.lit(1), F.size("_v")), pick))
    middle = lambda a: (F.get(a, F.expr(f"(size({a}) - 1) div 2").cast("int")) + F.get(a, F.expr(f"size({a}) div 2").cast("int"))) / 2
    lists = lists.withColumn("_d", drawn_values).withColumn("_m", middle("_d")).withColumn("_own", middle("_v"))
    return lists.groupBy(*keys).agg(F.percentile("_m", F.lit(low)).alias("low"), F.first("_own").alias("middle"), F.percentile("_m", F.lit(high)).alias("high"))
