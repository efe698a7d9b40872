"""The folder that driver and executors share."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import SparkSession

DEFAULT_SHARED = "file:///tmp/checkpoints/tidemark"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Without it a local session takes
    DEFAULT_SHARED and says so, and a cluster's session is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        warnings.warn(f"spark.checkpoint.dir is not set: work folders are below {DEFAULT_SHARED}", stacklevel=2)
        base = DEFAULT_SHARED
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
