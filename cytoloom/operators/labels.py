"""Labels of cells: filters by label, renames and mappings, summaries of clusters and samples."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytoloom.functions.draws import draw_quotas
from cytoloom.functions.percentiles import percentiles


def classifier_labels(df: DataFrame, column: str) -> DataFrame:
    """(label): the distinct labels, null left out."""
    return df.select(F.col(f"`{column}`").alias("label")).where("label IS NOT NULL").distinct()


def classifier_filter(df: DataFrame, column: str, labels: list[str], compat: bool = False) -> DataFrame:
    """The rows whose class holds one of the labels as a pattern; compat asks for exactly one of them."""
    hits = reduce(Column.__add__, [F.coalesce(F.col(f"`{column}`").rlike(x), F.lit(False)).cast("int") for x in labels], F.lit(0))
    return df.where(hits == 1 if compat else hits >= 1)


def row_cap(df: DataFrame, most: int, id_col: str = "cell_id", seed: int = 99) -> DataFrame:
    """At most so many rows, drawn by a hash of their id; all of them if there are no more."""
    quota = df.sparkSession.range(1).select(F.lit(0).alias("_every"), F.lit(most).alias("_quota"))
    return draw_quotas(df.withColumn("_every", F.lit(0)), quota, ["_every"], id_col, seed).drop("_every")


def check_size(df: DataFrame, cells: int = 1000, columns: int = 10, needed: tuple[str, ...] = ("cell_id", "x", "y")) -> DataFrame:
    """df itself; raises ValueError if it has too few rows or columns, or lacks a needed one. Counting stops at the limit."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if len(df.columns) < columns or df.limit(cells).count() < cells:
        raise ValueError(f"a table needs {cells} rows and {columns} columns at least")
    return df


def labelled(df: DataFrame, column: str) -> DataFrame:
    """The rows with a label; NaN and the text NA are no labels."""
    text = F.col(column).cast("string")
    return df.where(text.isNotNull() & ~F.lower(text).isin("nan", "na"))


def of_population(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def chosen(df: DataFrame, ids: DataFrame, id_col: str = "cell_id") -> DataFrame:
    """The rows whose id stands in ids: a lasso's selection, or the members of a gate."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def nonempty_samples(df: DataFrame, sample: str, count: str) -> DataFrame:
    """The rows of samples whose counts don't sum to zero."""
    good = df.groupBy(sample).agg(F.sum(count).alias("_s")).where("_s > 0").select(sample)
    return df.join(good, sample, "left_semi")


def display_rows(df: DataFrame, colour: str, most: int = 750_000, id_col: str = "cell_id", seed: int = 1) -> DataFrame:
    """Rows to draw: those with a colour, at most so many, drawn by hash. The cap is the feature."""
    return row_cap(df.where(F.col(colour).isNotNull()), most, id_col, seed)


def recode(column: Column, names: dict[str, str]) -> Column:
    """Labels by a map, all at once, so that renames can't run into each other; other labels stay."""
    if not names:
        return column
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, column), column)


def rename_groups(column: Column, groups: dict[str, str], pattern: bool = False) -> Column:
    """Samples by group; with pattern each key is a regular expression that is replaced wherever it occurs, in order."""
    return reduce(lambda c, kv: F.regexp_replace(c, kv[0], kv[1]), groups.items(), column) if pattern else recode(column, groups)


def recoded_by_table(df: DataFrame, column: str, table: DataFrame, old: str = "old", new: str = "new", out: str | None = None) -> DataFrame:
    """df with labels by a table of old and new ones, for maps too large for an expression; the first new label in order counts."""
    once = table.groupBy(F.col(old).alias("_old")).agg(F.min(new).alias("_new"))
    joined = df.join(once, df[column] == once["_old"], "left")
    return joined.withColumn(out or column, F.coalesce("_new", F.col(column))).drop("_old", "_new")


def two_levels(df: DataFrame, column: str, harmonised: dict[str, str], broad: dict[str, str]) -> DataFrame:
    """df with the harmonised label and its broad one."""
    df = df.withColumn(f"{column}_harmonised", recode(F.col(column), harmonised))
    return df.withColumn(f"{column}_broad", recode(F.col(f"{column}_harmonised"), broad))


def map_from_reply(reply: str) -> dict[str, str]:
    """The object of old and new labels in a model's reply, fenced or not; empty if there is none."""
    found = re.search(r"\{.*\}", reply or "", re.S)
    try:
        made = json.loads(found[0]) if found else {}
    except json.JSONDecodeError:
        return {}
    return {str(k): str(v) for k, v in made.items() if v is not None}


def binary_view(new: Column, old_labels: list[str], other: str = "else") -> Column:
    """The new label where it isn't one of the old ones, else ``else``."""
    return F.when(new.isin(*old_labels), F.lit(other)).otherwise(new)


def default_label(label: Column) -> Column:
    """What follows a cluster's number in its name, without dots at the end."""
    return F.regexp_replace(F.regexp_replace(label, r"^C[0-9]{1,2}-", ""), r"\.+$", "")


def prompt_label(label: Column) -> Column:
    return F.replace(F.replace(label, F.lit("+"), F.lit("pos")), F.lit("-"), F.lit("_"))


def matrix_label(label: Column) -> Column:
    return F.translate(F.replace(label, F.lit("+"), F.lit("pos")), " -", "..")


def subcluster_label(group: str, resolution: float, clusters: int, names: Column) -> Column:
    """The name of a subcluster column from an array of cluster names, as names.subcluster_name() makes it."""
    digest = F.substring(F.md5(F.array_join(names, "|")), 1, 8)
    return F.concat(F.lit(f"{group}_subclustered_res{resolution:g}_{clusters}clusters_"), digest)


def cluster_summary(df: DataFrame, column: str = "celltype") -> DataFrame:
    """(column, n, fraction), rows without a cluster included as null."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy()))  # one row per cluster


def sample_summary(df: DataFrame, sample: str = "sample_id", batch: str = "batch", order: str = "cell_id") -> DataFrame:
    """(sample, n, batch): the cells of each sample, and the batch of its first one."""
    return df.groupBy(sample).agg(F.count("*").alias("n"), F.min_by(batch, order).alias("batch"))


def file_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """(file, n_rows, n_columns) of several tables, in one job."""
    counts = [f.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("file"), "n_rows", F.lit(len(f.columns)).cast("long").alias("n_columns")) for k, f in frames.items()]
    return reduce(DataFrame.unionByName, counts)


def import_figures(expr: DataFrame, metadata_columns: int) -> DataFrame:
    """(cells, genes, metadata_columns, median_counts) of a long expression table."""
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("t"))
    counts = totals.agg(F.count("*").alias("cells")).join(percentiles(totals, [], "t", {"median_counts": 0.5}), how="left")
    genes = expr.select("feature").distinct().agg(F.count("*").alias("genes"))
    return counts.crossJoin(genes).withColumn("metadata_columns", F.lit(metadata_columns).cast("long"))  # one row each


def usage_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """The sums of token counts over all calls."""
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])


def ordered_types(df: DataFrame, column: str = "celltype") -> DataFrame:
    """(column, n, place): the most frequent first, ties by name; the order in which matrices report them. One row per type."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), column)))


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order; a top-k of all partitions, not a sort."""
    return df.orderBy(*order).limit(n)


def colour_range(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, few: int = 100, out: str = "colour") -> DataFrame:
    """df with the value clipped to two of its percentiles; unclipped if it has no more than ``few`` distinct values.

    Whether distinct values are few is decided by counting at most few + 1 of them.
    """
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct().limit(few + 1).agg((F.count("*") > few).alias("_many"))
    ends = percentiles(df, [], value, {"_lo": low, "_hi": high})
    clipped = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(value)))
    joined = df.crossJoin(F.broadcast(ends.crossJoin(distinct)))  # one row
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), F.when(F.col("_many"), clipped).otherwise(F.col(value)))).drop("_lo", "_hi", "_many")


def prompts(signatures: DataFrame, tissue: str, group: str = "celltype") -> DataFrame:
    """(group, prompt): what a language model would be asked about each cluster; the call itself is the caller's."""
    text = F.concat(F.lit(f"Tissue: {tissue}. Markers of the cluster: "), F.col("signature"), F.lit(". Name the cell type."))
    return signatures.select(group, text.alias("prompt"))
