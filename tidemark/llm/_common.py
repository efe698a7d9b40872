"""Helpers that several corpus operators share: tables, the shared folder, and written intermediate results."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by local sessions without spark.checkpoint.dir, as in tests on one machine.
DEFAULT_SHARED = "file:///tmp/checkpoints/tidemark"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of a record batch, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Without it a local session takes
    DEFAULT_SHARED and says so, and a cluster's session is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        warnings.warn(f"spark.checkpoint.dir is not set: intermediate tables go to {DEFAULT_SHARED}", stacklevel=2)
        found = DEFAULT_SHARED
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(docs: DataFrame, text_col: str = "text", each: int = 64 << 20) -> int:
    """Number of hash ranges that packed rows are dealt to: the session's shuffle partitions, and one for each `each` bytes
    of text at least, so that a range does not grow with the input. Reads the texts once."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))
