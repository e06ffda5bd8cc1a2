"""Writers: tables, populations, JSON, inputs of the curve and mask steps, bundles, and provenance records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import delimiter_of


def write_delimited(df: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of delimited files, one per task, with headers; tabs if the path ends in .tsv."""
    df.write.options(sep=delimiter_of(path), header=True, nullValue="NA", escape='"', compression=compression).mode("errorifexists").csv(path)


def population(df: DataFrame, gate: Column, added: tuple[str, ...] = ("x", "y", ".color_val"), original: list[str] | None = None) -> DataFrame:
    """The gated rows with all columns but those that were only added for drawing."""
    keep = set(original or [])
    return df.where(F.coalesce(gate, F.lit(False))).drop(*[c for c in added if c not in keep])


def write_population(df: DataFrame, path: str, gate: Column, **how) -> None:
    write_delimited(population(df, gate, **how), path)


def as_json(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """(value): each row as a JSON object, without the dropped columns."""
    kept = [c for c in df.columns if c not in drop]
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept])).alias("value"))


def write_json(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    as_json(df, drop).write.text(path)


def curve_input(cells: DataFrame, group: str = "celltype") -> DataFrame:
    """What the pair correlation step reads: sample, position, phenotype, and a tissue category.

    The category is the classifier's label, or else the analysis region, or else the sample; which of them is a matter of columns.
    """
    tissue = next((c for c in ("Classifier_Label", "Analysis_Region") if c in cells.columns), "sample_id")
    names = {"sample_id": "Sample Name", "x": "Cell X Position", "y": "Cell Y Position", group: "Phenotype"}
    return cells.select(*[F.col(old).alias(new) for old, new in names.items()], F.col(tissue).cast("string").alias("Tissue Category"))


def mask_column(columns: list[str], resolution: int, base: str = "cluster") -> str | None:
    """The cluster column of the highest resolution up to the given one; resolutions match as whole numbers."""
    found = {int(m[1]): c for c in columns if (m := re.search(rf"{base}.*res(\d+)(?!\d|\.\d)", c))}
    best = max((r for r in found if r <= resolution), default=None)
    return found.get(best)


def mask_input(cells: DataFrame, resolution: int, base: str = "cluster") -> DataFrame:
    """(x, y, cluster) by the best column that mask_column() finds; raises ValueError if there is none."""
    column = mask_column(cells.columns, resolution, base)
    if column is None:
        raise ValueError(f"no cluster column for a resolution up to {resolution}")
    return cells.select("x", "y", F.col(column).alias("cluster"))


def mask_markers(features: list[str], failed: list[str] = ()) -> list[str]:
    """Markers without compartment endings, each once, failed ones left out."""
    bare = (re.sub(r"_(Cytoplasm|Nucleus)$", "", f) for f in features if f not in failed)
    return list(dict.fromkeys(b for b in bare if b not in failed))


def write_bundle(tables: dict[str, DataFrame], folder: str, by: str = "sample_id") -> None:
    """Cells, expression and embeddings of an object, each as Parquet, by sample where there is one."""
    for name, df in tables.items():
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by) if by in df.columns else writer).parquet(f"{folder.rstrip('/')}/{name}")


def read_bundle(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names}


def file_records(spark: SparkSession, path: str, pattern: str = "*", without: tuple[str, ...] = ()) -> DataFrame:
    """(name, bytes, sha256) of the files under a path; hashes are made where the files are read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    out = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return out.where(~F.col("name").isin(*without)) if without else out


def provenance(inputs: DataFrame, outputs: DataFrame, parameters: dict[str, str], seeds: dict[str, int], started: str, ended: str) -> DataFrame:
    """One row (value): a JSON record of a run, with the file records of what it read and wrote."""
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct("name", "bytes", "sha256"))).alias(name))
    fixed = F.struct(
        F.create_map(*[F.lit(x) for pair in sorted(parameters.items()) for x in pair]).alias("parameters") if parameters else F.lit(None).cast("map<string,string>").alias("parameters"),
        F.create_map(*[F.lit(x) for pair in sorted(seeds.items()) for x in pair]).alias("seeds") if seeds else F.lit(None).cast("map<string,int>").alias("seeds"),
        F.lit(started).alias("started"), F.lit(ended).alias("ended"),
    )
    both = listed(inputs, "inputs").crossJoin(listed(outputs, "outputs"))  # one row each
    return both.select(F.to_json(F.struct(fixed.alias("run"), "inputs", "outputs")).alias("value"))


def changed_files(record: DataFrame, now: DataFrame, side: str = "outputs") -> DataFrame:
    """(name, was, is): the files of a provenance record whose hash isn't what it was; missing ones have no ``is``."""
    kept = F.from_json(F.get_json_object("value", f"$.{side}"), "array<struct<name:string,bytes:long,sha256:string>>")
    was = record.select(F.explode(kept).alias("f")).select("f.name", F.col("f.sha256").alias("was"))
    both = was.join(now.select("name", F.col("sha256").alias("is")), "name", "left")
    return both.where(~F.col("was").eqNullSafe(F.col("is")))
