"""Queries over readers, resolvers and writers: tables are written in some vendor's form and read again."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cytoloom.functions import stats as S
from cytoloom.operators import gates as G
from cytoloom.operators import matrices as X
from cytoloom.operators import neighbors as N
from cytoloom.sources import names as P
from cytoloom.sources import sinks as K
from cytoloom.sources import tables as T
from cytoloom.sources.folders import scratch_folder

from .common import EXPR, expression, lines, load, r6, registry
from .labels import MATRICES, matrices
from .tables import GATED, GATES

QUERIES, SQL, query = registry()


def written(df, spark, name: str, sep: str = ",", compression: str = "none") -> str:
    """The folder that df was written to as delimited text with a header."""
    folder = scratch_folder(spark, name)
    df.write.options(sep=sep, header=True, nullValue="NA", escape='"', compression=compression).csv(folder)
    return folder


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_semicolons(spark, sf_dir):
    """A semicolon-separated table; the delimiter comes from the header."""
    df = T.read_delimited(spark, written(load(spark, sf_dir, "customer"), spark, "semicolons", ";"))
    return df.withColumns({c: F.col(c).cast("long") for c in ("c_custkey", "c_nationkey")})


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def read_tabs_gz(spark, sf_dir):
    """A gzip-compressed table whose delimiter its name tells."""
    folder = scratch_folder(spark, "tabs") + ".tsv"
    K.write_delimited(load(spark, sf_dir, "supplier"), folder, "gzip")
    df = T.read_by_extension(spark, folder)
    return df.withColumns({c: F.col(c).cast("long") for c in ("s_suppkey", "s_nationkey")})


VENDOR = {"l_orderkey": "Object Id", "l_partkey": "XMin", "l_suppkey": "XMax", "l_quantity": "YMin", "l_extendedprice": "YMax", "l_discount": "CD3 Cell Intensity", "l_tax": "Cell Area (mm2)", "l_returnflag": "Classifier Label"}


def vendor(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(*[F.col(k).alias(v) for k, v in VENDOR.items()])


@query("SELECT l_orderkey AS cell_id, (l_partkey + l_suppkey) / 2 AS x, (l_quantity + l_extendedprice) / 2 AS y, l_discount AS \"CD3\", l_tax AS size, l_returnflag AS \"Classifier_Label\" FROM lineitem")
def clean_columns(spark, sf_dir):
    """A vendor's table under clean names, with the middle of its bounding boxes."""
    return T.renamed(vendor(spark, sf_dir)).select("cell_id", "x", "y", "CD3", "size", "Classifier_Label")


@query("SELECT l_orderkey, (l_partkey + l_suppkey) / 2 AS x, (l_quantity + l_extendedprice) / 2 AS y FROM lineitem")
def gating_centroids(spark, sf_dir):
    return T.with_centroids(vendor(spark, sf_dir))[0].select(F.col("Object Id").alias("l_orderkey"), "x", "y")


@query("""SELECT l_orderkey, l_linenumber, 'C' || CASE WHEN length(l_suppkey::VARCHAR) < 7 THEN lpad(l_suppkey::VARCHAR, 7, '0') ELSE l_suppkey::VARCHAR END
    || CASE WHEN row_number() OVER w > 1 THEN '.' || (row_number() OVER w - 1)::VARCHAR ELSE '' END AS cell_id FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)""")
def made_cell_ids(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return T.with_cell_ids(rows, "l_suppkey", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "cell_id")


MARKERS = ("quantity", "tax")


@query(" UNION ALL ".join(f"SELECT l_orderkey * 10 + l_linenumber AS cell_id, '{m}' AS feature, l_{m}::DOUBLE AS value FROM lineitem" for m in MARKERS))
def split_expression(spark, sf_dir):
    """The columns that a pattern chooses, in long form."""
    return T.split_table(lines(spark, sf_dir).drop("sample_id"), ["^(quan|ta)"])[0]


@query("SELECT p_partkey AS cell_id, p_size AS size, p_retailprice AS price, p_brand AS brand FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0")
def matched_tables(spark, sf_dir):
    """The files of an expression table and its metadata, each cut to the ids that both have, side by side."""
    part = load(spark, sf_dir, "part")
    a = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("gene_row"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    b = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    expression, metadata = T.read_matched_pair(spark, written(a, spark, "expression"), written(b, spark, "metadata"))
    return expression.join(metadata, "cell_id").withColumn("cell_id", F.col("cell_id").cast("long"))


@query("SELECT r_name AS name, r_regionkey::BIGINT AS k FROM region UNION ALL SELECT n_name, n_nationkey::BIGINT FROM nation")
def folder_scan(spark, sf_dir):
    """All files below a folder, by column name."""
    folder = scratch_folder(spark, "scan")
    load(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")).write.option("header", True).csv(f"{folder}/one")
    load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")).write.option("header", True).csv(f"{folder}/two/deep")
    return T.read_folder(spark, folder).select("name", F.col("k").cast("long").alias("k"))


@query("""SELECT r_name AS sample, n_name AS name, n_nationkey::BIGINT AS k, CASE WHEN n_regionkey % 2 = 0 THEN n_nationkey * 0.5::DOUBLE END AS score FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 4""")
def companion_scan(spark, sf_dir):
    """Files of different headers, in folders that name a sample; the files of the last region have no sample and are left out."""
    folder = scratch_folder(spark, "companions")
    regions = load(spark, sf_dir, "region")
    rows = load(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("r_regionkey") == F.col("n_regionkey"))  # one row per region
    parts = {"even": ("n_nationkey", "n_name", "score"), "odd": ("n_name", "n_nationkey")}
    for k, (name, columns) in enumerate(parts.items()):
        own = rows.where(F.col("n_regionkey") % 2 == k).withColumn("score", F.col("n_nationkey") * 0.5)
        own.select(F.concat(F.lit("scan of "), "r_name", F.lit(" 1")).alias("of"), *columns).write.partitionBy("of").option("header", True).csv(f"{folder}/{name}")
    samples = regions.where("r_regionkey <> 4").select(F.col("r_name").alias("sample"))
    found = T.read_companions(spark, folder, samples, "*.csv", newest_only=False)
    return found.select("sample", F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"), F.col("score").cast("double").alias("score"))


SCORES = {"l_suppkey": "Sample Name", "l_returnflag": "First Cell Compartment", "l_linestatus": "First Stain Component", "l_shipdate": "Second Cell Compartment", "l_linenumber": "Second Stain Component", "l_tax": "CD3 Threshold", "l_quantity": "Number of Cells"}


@query("SELECT l_suppkey AS sample, round(avg(l_tax), 9) AS threshold FROM lineitem GROUP BY l_suppkey")
def score_thresholds(spark, sf_dir):
    scores = load(spark, sf_dir, "lineitem").select(*[F.col(k).alias(v) for k, v in SCORES.items()])
    return T.score_tables(scores)[1].select(F.col("Sample Name").alias("sample"), F.round("CD3 Threshold", 9).alias("threshold"))


@query("SELECT l_suppkey AS sample, coalesce(stddev_samp(l_tax) > 0, false) AS threshold, coalesce(stddev_samp(l_quantity) > 0, false) AS cells FROM lineitem GROUP BY l_suppkey")
def score_discrepancies(spark, sf_dir):
    scores = load(spark, sf_dir, "lineitem").select(*[F.col(k).alias(v) for k, v in SCORES.items()])
    return T.score_tables(scores)[2].select(F.col("Sample Name").alias("sample"), F.col("CD3 Threshold").alias("threshold"), F.col("Number of Cells").alias("cells"))


@query(f"WITH {MATRICES} SELECT matrix, ref, query, value FROM pairs WHERE matrix = 'm1'")
def matrix_file(spark, sf_dir):
    """A matrix written as a square table, minus infinity included, and read again."""
    own = matrices(spark, sf_dir).where("matrix = 'm1'")
    square = X.wide(own, ["A", "N", "R"]).orderBy("query").coalesce(1)
    return T.read_matrix(spark, written(square, spark, "matrix"), "m1").select("matrix", "ref", "query", "value")


@query(f"WITH {EXPR} SELECT 'type ' || celltype AS celltype_name, feature AS marker, CASE WHEN avg(value) > 0 THEN '+' ELSE '-' END AS sign FROM expr GROUP BY celltype, feature")
def template_file(spark, sf_dir):
    """A template that asks of each type the signs of its own means, written as a file and read again."""
    means = expression(spark, sf_dir).groupBy("celltype", "feature").agg(F.avg("value").alias("m"))
    signs = F.concat("feature", F.when(F.col("m") > 0, "+").otherwise("-"))
    rows = means.groupBy(F.concat(F.lit("type "), "celltype").alias("CELLTYPE")).agg(F.array_join(F.sort_array(F.collect_list(signs)), ", ").alias("MARKERS"))
    return T.template_markers(T.read_template(spark, written(rows, spark, "template")))


@query(f"WITH {GATED} SELECT cell_id, G1, G2, G3 FROM gated")
def gate_file_replay(spark, sf_dir):
    """Gates from their JSON form."""
    made = {}
    for g in GATES:
        own = {k: v for k, v in g.items() if k[2:] not in ("lo", "hi")}
        made[g["id"]] = own | {f"{a}_threshold": g.get(f"{a}_lo") for a in "xy"} | {f"{a}_threshold_max": g.get(f"{a}_hi") for a in "xy"}
    return G.replay_gates(lines(spark, sf_dir), G.gates_from_json(json.dumps(made))).select("cell_id", "G1", "G2", "G3")


@query("""SELECT l_linenumber::VARCHAR AS "Sample Name", l_quantity AS "Cell X Position", l_extendedprice AS "Cell Y Position", l_returnflag || l_linestatus AS "Phenotype", l_linenumber::VARCHAR AS "Tissue Category" FROM lineitem""")
def curve_input(spark, sf_dir):
    cells = lines(spark, sf_dir).withColumnsRenamed({"quantity": "x", "extendedprice": "y"}).withColumn("sample_id", F.col("sample_id").cast("string"))
    return K.curve_input(cells)


@query("SELECT l_quantity AS x, l_extendedprice AS y, l_linestatus AS cluster FROM lineitem")
def mask_input(spark, sf_dir):
    names = {"l_quantity": "x", "l_extendedprice": "y", "l_returnflag": "cluster_leiden_res1_clust3", "l_linestatus": "cluster_leiden_res4_clust2"}
    return K.mask_input(load(spark, sf_dir, "lineitem").select(*[F.col(k).alias(v) for k, v in names.items()]), 7)


@query("SELECT event_id, event_type, user_id FROM events WHERE value > 200")
def population_export(spark, sf_dir):
    """A gated population written without the columns that were added for drawing, and read again."""
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value").withColumn("x", F.col("value"))
    folder = scratch_folder(spark, "population")
    K.write_population(rows, folder, F.col("x") > 200, added=("x", "value"))
    return T.read_delimited(spark, folder, least=2).select(F.col("event_id").cast("long"), "event_type", F.col("user_id").cast("long"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def json_export(spark, sf_dir):
    folder = scratch_folder(spark, "json")
    K.write_json(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_brand"), folder, drop=("p_brand",))
    return spark.read.schema("p_partkey long, p_name string, p_retailprice double").json(folder)


@query("SELECT l_linenumber AS sample_id, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def bundle(spark, sf_dir):
    """An object's tables written by sample and read again."""
    folder = scratch_folder(spark, "bundle")
    K.write_bundle({"cells": lines(spark, sf_dir)}, folder)
    return K.read_bundle(spark, folder, ["cells"])["cells"].groupBy(F.col("sample_id").cast("int").alias("sample_id")).agg(F.count("*").alias("n"))


@query()
def provenance(spark, sf_dir):
    """A record of a run's files; that nothing has changed since is checked in tests."""
    folder = written(load(spark, sf_dir, "region"), spark, "provenance")
    files = K.file_records(spark, folder, "*.csv")
    return K.provenance(files, files, {"radius": "25"}, {"seed": 99}, "2026-01-01T00:00:00Z", "2026-01-01T00:00:05Z")


@query()
def demo_autocorrelation(spark, sf_dir):
    """Moran's I over a demonstration tissue of one cell for each vector; genes 51 to 53 follow the place."""
    cells = T.demo_cells(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))
    return S.morans_i(N.knn_edges(cells, 10), T.demo_expression(cells, 60).select("cell_id", "feature", "value")).select("feature", "i", "p_adj").withColumns(r6("i"))


@query("SELECT DISTINCT p_brand || ': ' || p_type || ' (µm)' AS name, trim(regexp_replace(replace(lower(p_brand || ': ' || p_type || ' (µm)'), 'µm', 'um'), '[^a-z0-9]+', '_', 'g'), '_') AS snake FROM part")
def snake_names(spark, sf_dir):
    """Column names made of the brands and types of parts; the names of a table's columns are a list on the driver."""
    found = load(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(": "), "p_type", F.lit(" (µm)")).alias("name")).distinct()
    given = [r["name"] for r in found.collect()]  # brands x types
    return spark.createDataFrame(list(zip(given, P.snake(given))), "name string, snake string")
