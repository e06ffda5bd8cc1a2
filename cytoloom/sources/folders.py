"""Folders for files that later jobs read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names. In local mode any folder will do where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="cytoloom-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
