"""Comparisons of samples and files: counts, proportions, kinds of columns, unions, downsampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cytoloom.functions.draws import draw_quotas

YES_NO = ("0", "1", "t", "f", "true", "false", "yes", "no")


def cell_counts(cells: DataFrame, sample: str = "sample_id", kind: str = "celltype") -> DataFrame:
    """(sample, type, n, density): every pair of them, zeros filled in; density is the share of the sample."""
    n = cells.where(F.col(kind).isNotNull()).groupBy(sample, kind).agg(F.count("*").alias("n"))
    full = n.select(sample).distinct().crossJoin(n.select(kind).distinct())  # samples x types
    out = full.join(n, [sample, kind], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("density", F.col("n") / F.sum("n").over(W.partitionBy(sample)))


def proportions(df: DataFrame, column: str) -> DataFrame:
    """(column, n, proportion) over the rows where the column isn't null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("proportion", F.col("n") / F.sum("n").over(W.partitionBy()))  # one row per value


def binary_mean(df: DataFrame, column: str, by: str) -> DataFrame:
    """Mean of a 0/1-like column (numbers, true/false, yes/no) by group."""
    text = F.lower(F.col(column).cast("string"))
    value = F.when(text.isin("1", "t", "true", "yes", "1.0"), 1.0).when(text.isin("0", "f", "false", "no", "0.0"), 0.0)
    return df.groupBy(by).agg(F.avg(value).alias("mean"))


def column_kinds(df: DataFrame, columns: list[str], max_levels: int = 10) -> DataFrame:
    """(column, kind): binary, categorical or continuous. Text is binary or categorical, whatever its number of levels.

    Binary columns have at most two distinct values, all of them like 0/1, true/false or yes/no. Values are counted with map-side
    combine; of each column only the first max_levels + 1 distinct ones, in order of a hash, leave the tasks that counted them.
    """
    number = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    text = lambda c: F.regexp_replace(F.lower(F.col(c).cast("string")), r"\.0$", "")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(number[c]).alias("number"), text(c).alias("v")) for c in columns]))
    levels = df.select(pairs.alias("p")).select("p.*").where("v IS NOT NULL").groupBy("column", "number", "v").agg(F.count("*").alias("n"))
    first = levels.withColumn("k", F.row_number().over(W.partitionBy("column").orderBy(F.xxhash64("v"), "v"))).where(F.col("k") <= max_levels + 1)
    found = first.groupBy("column", "number").agg(F.count("*").alias("n"), F.bool_and(F.col("v").isin(*YES_NO)).alias("plain"))
    kind = F.when(F.col("n").isNull() | (F.col("plain") & (F.col("n") <= 2)), "binary").when(~F.col("number") | (F.col("n") <= max_levels), "categorical").otherwise("continuous")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(found, "column", "left").select("column", kind.alias("kind"))


def zero_filled(counts: DataFrame, samples: DataFrame, by: str = "sample_id") -> DataFrame:
    """counts for every sample; samples that lack the type get zeros."""
    filled = samples.join(counts, by, "left")
    return filled.fillna(0, subset=[c for c, t in counts.dtypes if c != by and t not in ("string", "boolean")])


def harmonised_union(frames: dict[str, DataFrame], label: str = "sample_id") -> DataFrame:
    """All rows with the union of all columns, missing ones null, and the frame's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(label, F.lit(k)) for k, f in frames.items()])


def common_values(df: DataFrame, value: str, file: str) -> DataFrame:
    """Values that stand in every file."""
    files = df.agg(F.count_distinct(file).alias("_n"))
    each = df.groupBy(value).agg(F.count_distinct(file).alias("_k"))
    return each.crossJoin(F.broadcast(files)).where("_k = _n").select(value)  # one row


def stratified_downsample(df: DataFrame, n: int, by: str, id_col: str, seed: int = 99) -> DataFrame:
    """About n rows in the proportions of the classes: exact quotas by largest remainder, rows by a hash of id and seed."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_size"))
    all_rows = F.sum("_size").over(W.partitionBy())
    exact = F.least(F.lit(1.0), n / all_rows) * F.col("_size")
    quota = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    spare = F.least(F.lit(n), all_rows) - F.sum("_floor").over(W.partitionBy())
    order = F.row_number().over(W.orderBy(F.desc(F.col("_exact") - F.col("_floor")), by))  # one row per class
    quota = quota.withColumn("_quota", F.col("_floor") + F.when(order <= spare, 1).otherwise(0)).select(by, "_quota")
    return draw_quotas(df, quota, [by], id_col, seed)


def newest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row of each key: that with the greatest order."""
    best = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("_best"))
    return best.select(*key, "_best.*").select(df.columns)


def cumulative_ranges(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """sizes with start and end of contiguous blocks of rows, from 0; one row per cluster."""
    end = F.sum(size).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return sizes.withColumn("end", end).withColumn("start", F.col("end") - F.col(size))


def rising(df: DataFrame, order: str, value: str, most: float) -> DataFrame:
    """Rows whose value is above all before them, up to the first that exceeds most."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.max(value).over(w)
    out = df.withColumn("_before", before).withColumn("_over", F.coalesce(F.max(F.col(value) > most).over(w), F.lit(False)))
    return out.where((F.col("_before").isNull() | (F.col(value) > F.col("_before"))) & ~F.col("_over") & (F.col(value) <= most)).drop("_before", "_over")


def thresholds_differ(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, one boolean per column): whether a group's values differ."""
    return df.groupBy(by).agg(*[F.coalesce(F.stddev_samp(c) > 0, F.lit(False)).alias(c) for c in columns])


def threshold_signs(df: DataFrame, thresholds: DataFrame, by: str, values: list[str]) -> DataFrame:
    """1 where a value reaches its sample's threshold, else -1; nulls count as 0."""
    t = thresholds.select(by, *[F.col(v).alias(f"_t_{v}") for v in values])
    return df.join(t, by).withColumns({v: F.signum(F.coalesce(v, F.lit(0.0)) - F.col(f"_t_{v}") + 1e-6).cast("int") for v in values}).select(*df.columns)
