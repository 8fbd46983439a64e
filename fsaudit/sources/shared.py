"""The folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def own_folder(spark: SparkSession, what: str) -> str:
    """A new folder in that of spark.checkpoint.dir; only a local session, whose driver is its one executor, does without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/spark-shared"
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
