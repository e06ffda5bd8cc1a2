"""Readers of cell tables, matrices, scores, templates and gates.

Only header lines are looked at on the driver, through Spark's own text reader, so that any path that Spark reads will do. Tables
stay lazy. A column whose every value reads as a number becomes a number when infer is set; else all columns are text.
"""

from __future__ import annotations

import csv
import math
import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import names

#: Delimiters in order of preference.
DELIMITERS = ("\t", ",", ";")


def header_line(spark: SparkSession, path: str) -> str:
    """The first line of a file or folder of files; empty for an empty one."""
    first = spark.read.text(path).limit(1).first()
    return first[0].lstrip("﻿") if first else ""


def split_line(line: str, sep: str) -> list[str]:
    return next(csv.reader([line], delimiter=sep), [])


def sniff(line: str, least: int = 5) -> str:
    """The first delimiter that gives at least ``least`` columns; else the one that gives most."""
    sizes = {d: len(split_line(line, d)) for d in DELIMITERS}
    return next((d for d in DELIMITERS if sizes[d] >= least), max(DELIMITERS, key=lambda d: sizes[d]))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, infer: bool = True, least: int = 5) -> DataFrame:
    """A delimited table, plain or .gz, with its header's names; short rows are filled with nulls.

    Without sep the delimiter is the one that the header tells. Repeated and empty names get numbers. An empty file has no
    columns and no rows.
    """
    line = header_line(spark, path)
    if not line:
        return spark.range(0).select()
    sep = sep or sniff(line, least)
    columns = names.made_unique([n or f"V{k}" for k, n in enumerate(split_line(line, sep), 1)])
    how = {"sep": sep, "header": True, "mode": "PERMISSIVE", "inferSchema": infer, "nullValue": "NA", "escape": '"', "enforceSchema": True}
    return spark.read.options(**how).csv(path).toDF(*columns)


def read_by_extension(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A table whose delimiter its name tells: tab for .tsv and .tsv.gz, else comma."""
    return read_delimited(spark, path, names.delimiter_of(path), infer)


def sample_name(path: str) -> str:
    return re.sub(r"\.(csv|tsv|txt)(\.gz)?$", "", os.path.basename(path), flags=re.I)


def file_name() -> Column:
    """The name, without extension, of the file that a row was read from."""
    return F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(?i)\.(csv|tsv|txt)(\.gz)?$", "")


def read_samples(spark: SparkSession, paths: list[str], infer: bool = True) -> dict[str, DataFrame]:
    """One table per file by sample name; empty files are left out. Commas are taken first, then what the header tells."""
    found = {sample_name(p): read_delimited(spark, p, infer=infer, least=2) for p in paths}
    return {k: f.withColumn("sample_id", F.lit(k)) for k, f in found.items() if f.columns}


def read_legacy(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A tab-separated table with a Path column, or else comma-separated, with the names of old exports repaired."""
    line = header_line(spark, path)
    found = read_delimited(spark, path, "\t" if "Path" in split_line(line, "\t") else ",", infer)
    return found.toDF(*names.repaired_legacy_names(found.columns))


def with_row_ids(df: DataFrame, out: str = "row_id") -> DataFrame:
    """df, as a reader gave it, with each row's place from 1 in the order of the files' paths and of the rows in them.

    A row's place inside its block of a file comes from the order in which the task reads it; blocks are counted and summed up in order, one
    row each. So ids are the same however files are split. Tables that aren't read from files get increasing ids with gaps.
    """
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    except AnalysisException:
        return df.withColumn(out, F.monotonically_increasing_id() + 1)
    blocks = rows.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per block of a file
    rows = rows.join(blocks.select("_path", "_block", "_first", before.alias("_before")), ["_path", "_block"])
    return rows.withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_path", "_block", "_at", "_first", "_before")


def renamed(df: DataFrame) -> DataFrame:
    """df under clean names, with x and y from the bounding box where nothing else gives them."""
    how = names.clean_names(df.columns)
    out = df.toDF(*how.names)
    return out.withColumns({axis: (F.col(a) + F.col(b)) / 2 for axis, (a, b) in how.midpoints.items()})


def with_centroids(df: DataFrame) -> tuple[DataFrame, names.Centroids | None]:
    """df with x and y for gating, and where they come from; unchanged if there are no coordinates."""
    found = names.centroids(df.columns)
    if found is None:
        return df, None
    middle = lambda cs: sum((F.col(f"`{c}`") for c in cs[1:]), F.col(f"`{cs[0]}`")) / len(cs)
    return df.withColumns({"x": middle(found.x), "y": middle(found.y)}), found


def with_cell_ids(df: DataFrame, source: str | None = "cell_id", order: list[str] | None = None, out: str = "cell_id") -> DataFrame:
    """df with text ids: numbers become C and seven digits at least; repetitions get .1, .2 and so on.

    Without a source column ids are row numbers. Repetitions are numbered in the order of the given columns within one id, so no
    window spans more than the rows of an id.
    """
    if source is None or source not in df.columns:
        df, source = with_row_ids(df, "_row"), "_row"
        text = F.col(source).cast("string")
        return df.withColumn(out, text).drop("_row")
    numeric = dict(df.dtypes)[source] not in ("string", "boolean")
    text = F.col(source).cast("string")
    base = F.concat(F.lit("C"), F.when(F.length(text) < 7, F.lpad(text, 7, "0")).otherwise(text)) if numeric else text
    df = df.withColumn("_base", base)
    # Rows without an id stay without one; they are kept out of each other's window.
    apart = F.when(F.col("_base").isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    place = F.row_number().over(W.partitionBy("_base", apart).orderBy(*(order or [source])))
    return df.withColumn(out, F.when(place > 1, F.concat("_base", F.lit("."), (place - 1).cast("string"))).otherwise(F.col("_base"))).drop("_base")


def long_expression(df: DataFrame, columns: list[str], cell_id: str = "cell_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cell_id, feature, value) of the given columns."""
    ids = [*keys, cell_id]
    narrow = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return narrow.unpivot(ids, columns, "feature", "value").withColumnRenamed(cell_id, "cell_id")


def split_table(df: DataFrame, patterns: list[str], cell_id: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """(expression in long form, metadata): the columns that the patterns choose, and all others."""
    chosen = names.expression_columns([c for c in df.columns if c != cell_id], patterns)
    return long_expression(df, chosen, cell_id), df.select(*[F.col(f"`{c}`") for c in df.columns if c not in set(chosen)])


def matched_pair(expression: DataFrame, metadata: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """A wide expression table and its metadata, cut to the ids both have; the first column of each is the id.

    Raises ValueError if fewer than ``least`` ids are common; counting them is the only action.
    """
    a, b = expression.columns[0], metadata.columns[0]
    expression, metadata = expression.withColumnRenamed(a, "cell_id"), metadata.withColumnRenamed(b, "cell_id")
    both = expression.select("cell_id").distinct().join(metadata.select("cell_id").distinct(), "cell_id")
    if both.limit(least).count() < least:
        raise ValueError(f"fewer than {least} ids are in both tables")
    return expression.join(both, "cell_id", "left_semi"), metadata.join(both, "cell_id", "left_semi")


def read_matched_pair(spark: SparkSession, expression: str, metadata: str, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """matched_pair() of two files; .tsv and .txt are tab-separated."""
    read = lambda p: read_delimited(spark, p, "\t" if re.search(r"\.(tsv|txt)(\.gz)?$", p, re.I) else ",")
    return matched_pair(read(expression), read(metadata), least)


def file_headers(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file_path, header): the first line of each file of a folder and its subfolders that matches."""
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter=pattern).text(folder)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.select(F.col("_metadata.file_path").alias("file_path"), "value", at.alias("at")).where("at.block = 0")
    return lines.groupBy("file_path").agg(F.ltrim(F.min_by("value", "at"), F.lit("\ufeff")).alias("header"))


def united(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables by column name, in the order in which names come first; a table without a column has nulls there. Of
    differing types, whole numbers become long, other numbers double, and all else text."""
    types: dict[str, set[str]] = {}
    for t in tables:
        for name, kind in t.dtypes:
            types.setdefault(name, set()).add(kind)
    whole, numbers = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}
    common = lambda kinds: next(iter(kinds)) if len(kinds) == 1 else "bigint" if kinds <= whole else "double" if kinds <= whole | numbers else "string"
    cast = [t.select(*[F.col(f"`{n}`").cast(common(k)).alias(n) if n in t.columns else F.lit(None).cast(common(k)).alias(n) for n, k in types.items()]) for t in tables]
    return reduce(DataFrame.union, cast)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.csv", newest_only: bool = False, columns: list[str] | None = None, most_headers: int = 200) -> DataFrame:
    """All files of a folder and its subfolders that match, by column name, with file_name, file_path and the time they were changed.

    Files are grouped by their header and delimiter and each group is read under its own, so columns may stand in any order or be missing. The
    headers' lines are found by a scan; more than ``most_headers`` different ones raise ValueError. newest_only keeps, of files with one
    name, those changed last; files are compared, not rows.
    """
    found = file_headers(spark, folder, pattern).where("header <> ''").groupBy("header").agg(F.collect_list("file_path").alias("paths"))
    groups = sorted(found.limit(most_headers + 1).collect())  # the reader keeps a list of all files on the driver anyway
    if len(groups) > most_headers:
        raise ValueError(f"the files have more than {most_headers} different headers")
    if not groups:
        return spark.range(0).select()
    tables = []
    for header, paths in groups:
        sep = sniff(header, 2)
        given = names.made_unique([n or f"V{k}" for k, n in enumerate(split_line(header, sep), 1)])
        rows = spark.read.options(sep=sep, header=True, nullValue="NA", escape='"', inferSchema=True).csv(sorted(unquote(p) for p in paths))
        rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, given)], file_name().alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("changed"))
        tables.append(rows)
    rows = united(tables)
    if columns:
        rows = rows.select(*[F.col(f"`{c}`") for c in columns], "file_name", "file_path", "changed")
    else:
        rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("file_name", "file_path", "changed")], "file_name", "file_path", "changed")
    if not newest_only:
        return rows
    best = rows.groupBy("file_name").agg(F.max_by("file_path", F.struct("changed", "file_path")).alias("file_path"))
    return rows.join(best, ["file_name", "file_path"], "left_semi").select(rows.columns)


def companions(files: DataFrame, samples: DataFrame) -> DataFrame:
    """(file_path, sample): files (file_path) and the samples (sample) whose names a folder or file of their path holds.

    Names are met by equality with the pieces of a path's parts that are as long as some name, so nothing is compared with everything.
    """
    lengths = [r[0] for r in samples.select(F.length("sample").alias("n")).where("n > 0").distinct().collect()]  # of names: at most 255
    parts = files.select("file_path").distinct().select("file_path", F.explode(F.split(F.regexp_replace("file_path", "^[a-z]+:/*", ""), "/")).alias("part"))
    at = F.explode(F.array(*[F.lit(n) for n in lengths])) if lengths else F.explode(F.array().cast("array<int>"))
    pieces = parts.withColumn("n", at).where(F.length("part") >= F.col("n")).withColumn("k", F.explode(F.expr("sequence(1, length(part) - n + 1)")))
    pieces = pieces.select("file_path", F.expr("substring(part, k, n)").alias("sample")).distinct()
    return pieces.join(samples.select("sample").distinct(), "sample").select("file_path", "sample")


def read_companions(spark: SparkSession, folder: str, samples: DataFrame, pattern: str = "*score_data.txt", newest_only: bool = True) -> DataFrame:
    """read_folder() with sample: the rows of a file once for each of the samples (sample) that its path names; other files are left out."""
    rows = read_folder(spark, folder, pattern, newest_only)
    if "file_path" not in rows.columns:
        return rows
    return rows.join(companions(rows.select("file_path").distinct(), samples), "file_path")


def score_tables(scores: DataFrame, sample: str = "Sample Name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of score rows: (stains with their compartments, mean thresholds by sample, whether a sample's values differ)."""
    part = lambda n: scores.select(F.col(sample), F.col(f"{n} Cell Compartment").alias("compartment"), F.col(f"{n} Stain Component").alias("component"))
    stains = part("First").union(part("Second")).distinct()
    values = [c for c in scores.columns if c.endswith(" Threshold")]
    means = scores.groupBy(sample).agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in values])
    checked = [*values, *(c for c in ("Number of Cells",) if c in scores.columns)]
    differ = scores.groupBy(sample).agg(*[F.coalesce(F.stddev_samp(F.col(f"`{c}`").cast("double")) > 0, F.lit(False)).alias(c) for c in checked])
    return stains, means, differ


def newest_scores(scores: DataFrame, sample: str = "Sample Name", changed: str = "changed") -> DataFrame:
    """Of the score rows of one sample and pair of stains those read from the file changed last; one of them."""
    keys = [sample, "First Stain Component", "Second Stain Component"]
    row = F.struct(*[F.col(f"`{c}`") for c in scores.columns])
    best = scores.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, F.col(changed)).alias("best"))
    return best.select("best.*")


def read_matrix(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(matrix, query, ref, value) of a square matrix file: rows are queries, the first column their names, and columns, in the
    order of the rows, references. ``-Inf``, ``Inf`` and ``NaN`` are numbers."""
    df = read_delimited(spark, path, infer=False, least=2)
    rows, columns = df.columns[0], df.columns[1:]
    order = [r[0] for r in df.select(F.col(f"`{rows}`")).collect()]  # one row per cell type
    if len(order) != len(columns):
        raise ValueError("the matrix isn't square")
    number = lambda c: F.regexp_replace(F.col(f"`{c}`"), "(?i)^([+-]?)inf$", "$1Infinity").cast("double")
    wide = df.select(F.col(f"`{rows}`").alias("query"), *[number(c).alias(f"c{k}") for k, c in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("ref"), F.col(f"c{k}").alias("value")) for k, t in enumerate(order)]))
    return wide.select(F.lit(name or sample_name(path)).alias("matrix"), "query", pairs.alias("p")).select("matrix", "query", "p.*")


def read_curves(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Curve tables one below the other: row names dropped, one or two dots in names as a space, only what all files have."""
    frames = [read_delimited(spark, p, least=2) for p in paths]
    frames = [f.drop(f.columns[0]).toDF(*[re.sub(r"\.{1,2}", " ", c) for c in f.columns[1:]]) for f in frames]
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(*[F.col(f"`{c}`") for c in common]) for f in frames])


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """(celltype_name, markers) of a phenotype template file with the columns CELLTYPE and MARKERS."""
    df = read_delimited(spark, path, infer=False, least=2)
    return df.select(F.trim("CELLTYPE").alias("celltype_name"), F.trim("MARKERS").alias("markers")).where("celltype_name IS NOT NULL AND markers IS NOT NULL")


def template_markers(template: DataFrame) -> DataFrame:
    """(celltype_name, marker, sign): only the last sign of a marker is its sign, so names may hold signs."""
    each = template.select("celltype_name", F.explode(F.split("markers", r"\s*,\s*")).alias("m"))
    return each.select("celltype_name", F.regexp_replace("m", r"[+-]$", "").alias("marker"), F.regexp_extract("m", r"[+-]$", 0).alias("sign"))


def uniform(*key: Column) -> Column:
    """A number from 0 to 1, 1 excluded, by the hash of its key, so that reruns and other partitions agree."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def normal(*key: Column) -> Column:
    """A standard normal number by hashes of its key."""
    return F.sqrt(-2 * F.log(1 - uniform(F.lit("size"), *key))) * F.cos(2 * math.pi * uniform(F.lit("angle"), *key))


def demo_cells(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A cell of a demonstration tissue for each id: five clusters of normal spread 100, with area, blank counts and field of view."""
    places = [(200, 200, 0.30), (800, 200, 0.50), (500, 600, 0.70), (200, 800, 0.85), (800, 800, 1.00)]  # fixed values: centre, cumulative share
    key = lambda tag: (F.lit(seed), F.lit(tag), F.col("id"))
    df = ids.select("id").withColumn("u", uniform(*key("cluster")))
    cluster = reduce(lambda acc, k: F.when(F.col("u") < places[k][2], k).otherwise(acc), reversed(range(len(places))), F.lit(len(places) - 1))
    centre = lambda axis: F.get(F.array(*[F.lit(float(p[axis])) for p in places]), F.col("cluster"))
    df = df.withColumn("cluster", cluster).withColumns({"x": centre(0) + 100 * normal(*key("x")), "y": centre(1) + 100 * normal(*key("y"))})
    area = F.exp(F.log(F.lit(200.0)) + 0.5 * normal(*key("area")))
    fov = F.when(F.col("x") < 500, 0).otherwise(1) + F.when(F.col("y") < 500, 0).otherwise(2)
    ids = F.concat(F.lit("cell_"), F.lpad((F.col("id") + 1).cast("string"), 5, "0"))
    return df.select(
        ids.alias("cell_id"), F.concat(F.lit("fov_"), fov.cast("string")).alias("sample_id"), "x", "y", F.concat(F.lit("C"), F.col("cluster").cast("string")).alias("celltype"),
        area.alias("area"), poisson(F.lit(1.0), 12, F.lit(seed), F.col("id"), F.lit("blank")).alias("blank_counts"),
    )


def poisson(rate: Column, steps: int, *key: Column) -> Column:
    """A Poisson draw by inversion of one hash-based uniform; ``steps`` bounds the values."""
    u = uniform(*key)
    start = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(s, k):
        p = s["p"] * rate / k
        more = u > s["c"]
        return F.struct((s["n"] + more.cast("int")).alias("n"), p.alias("p"), (s["c"] + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["n"])


def demo_expression(cells: DataFrame, genes: int = 150, seed: int = 42) -> DataFrame:
    """(cell_id, feature, value): background counts, ten markers for each cluster, and three genes that follow the place.

    Genes 51 to 53 rise with x, with y, and with a wave over x.
    """
    rows = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(genes))))
    own = F.floor((F.col("k") - 1) / 10).cast("int") == F.substring("celltype", 2, 9).cast("int")
    value = poisson(F.lit(2.0), 24, F.lit(seed), F.col("cell_id"), F.col("k")).cast("double")
    value = value + F.when(own, poisson(F.lit(15.0), 64, F.lit(seed + 1), F.col("cell_id"), F.col("k"))).otherwise(0)
    trend = F.when(F.col("k") == 51, F.col("x") / 50).when(F.col("k") == 52, F.col("y") / 40).when(F.col("k") == 53, 10 * F.sin(F.col("x") / 150)).otherwise(0.0)
    name = F.concat(F.lit("Gene_"), F.lpad(F.col("k").cast("string"), 3, "0"))
    return rows.select("cell_id", "celltype", "x", "y", name.alias("feature"), F.greatest(F.lit(0.0), F.floor(value + trend)).cast("double").alias("value"))
