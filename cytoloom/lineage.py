"""Cutting lineage, so that rounds of an iteration survive lost executors and aren't computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cytoloom.sources.folders import scratch_folder


def materialize(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder that spark.checkpoint.dir names, and read again.

    Other than a checkpoint, a table has the size of what it holds, not one that is guessed from all joins before it; so a later join knows
    what is small, however many rounds there were.
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
