"""Cell tables: adapters that give other tables the columns cell_id, sample_id, x, y and celltype."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells_from_events(events: DataFrame) -> DataFrame:
    """Events as cells: x is the value, y a third of the minute of the day, the type the event type, the sample the day modulo 4."""
    return events.select(
        F.col("event_id").alias("cell_id"),
        (F.dayofmonth("ts") % 4).cast("int").alias("sample_id"),
        F.col("value").cast("double").alias("x"),
        ((F.hour("ts") * 60 + F.minute("ts")) / F.lit(3.0)).alias("y"),
        F.col("event_type").alias("celltype"),
    )


def cells_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Vectors as cells at their first two components."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return embeddings.select(F.col("vec_id").alias("cell_id"), at(0).alias("x"), at(1).alias("y"), F.col("label").cast("string").alias("celltype"))


def expression_from_embeddings(embeddings: DataFrame, features: int | None = None) -> DataFrame:
    """Vectors as long expression rows: cell_id, celltype, feature (g00, g01, ...), value."""
    vector = F.slice("embedding", 1, features) if features else F.col("embedding")
    rows = embeddings.select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("celltype"), F.posexplode(vector).alias("k", "v"))
    name = F.concat(F.lit("g"), F.lpad(F.col("k").cast("string"), 2, "0"))
    return rows.select("cell_id", "celltype", name.alias("feature"), F.col("v").cast("double").alias("value"))


def cells_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Order lines as cells with four markers; the type is return flag and line status."""
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"),
        F.col("l_linenumber").cast("int").alias("sample_id"),
        F.concat("l_returnflag", "l_linestatus").alias("celltype"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast("double").alias("extendedprice"),
        F.col("l_discount").cast("double").alias("discount"),
        F.col("l_tax").cast("double").alias("tax"),
    )
