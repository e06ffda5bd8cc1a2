"""What the query modules share: registration, tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.cells import cells_from_embeddings, cells_from_events, cells_from_lineitem, expression_from_embeddings

EVENTS = """cells AS (SELECT event_id AS cell_id, (day(ts) % 4)::INT AS sample_id, value::DOUBLE AS x,
                 (hour(ts) * 60 + minute(ts)) / 3.0::DOUBLE AS y, event_type AS celltype FROM events)"""
VECTORS = "cells AS (SELECT vec_id AS cell_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::VARCHAR AS celltype FROM embeddings)"
EXPR = """expr AS (SELECT vec_id AS cell_id, label::VARCHAR AS celltype, 'g' || lpad((k - 1)::VARCHAR, 2, '0') AS feature, embedding[k]::DOUBLE AS value
    FROM embeddings, range(1, 65) AS t(k))"""
POSITIVE = EXPR.replace("embedding[k]::DOUBLE", "abs(embedding[k]::DOUBLE)")
LINES = """cells AS (SELECT l_orderkey * 10 + l_linenumber AS cell_id, l_returnflag || l_linestatus AS celltype, l_quantity::DOUBLE AS quantity,
    l_extendedprice::DOUBLE AS extendedprice, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax FROM lineitem)"""
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def registry():
    """(queries, SQL, decorator that adds a query and its SQL, if there is one)."""
    queries: dict = {}
    sql_of: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sql_of[f.__name__] = sql
            return f

        return add

    return queries, sql_of, query


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark, sf_dir) -> DataFrame:
    return cells_from_events(load(spark, sf_dir, "events"))


def vectors(spark, sf_dir) -> DataFrame:
    return cells_from_embeddings(load(spark, sf_dir, "embeddings"))


def expression(spark, sf_dir) -> DataFrame:
    return expression_from_embeddings(load(spark, sf_dir, "embeddings"))


def lines(spark, sf_dir) -> DataFrame:
    return cells_from_lineitem(load(spark, sf_dir, "lineitem"))


def r6(*columns: str):
    return {c: F.round(c, 6) for c in columns}


def KNN(k: int) -> str:
    return f"""{VECTORS}, e AS (SELECT a.cell_id AS src, b.cell_id AS dst, a.celltype AS src_type, b.celltype AS dst_type, {D2} AS d2,
        row_number() OVER (PARTITION BY a.cell_id ORDER BY {D2}, b.cell_id) AS rank FROM cells a JOIN cells b ON a.cell_id <> b.cell_id QUALIFY rank <= {k})"""
