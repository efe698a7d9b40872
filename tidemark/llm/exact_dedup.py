"""Exact deduplication by content hash, with the bytes compared inside each group."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import read


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def text_sha256(text: Column) -> Column:
    """The text_sha256 of exact_dedup."""
    return F.sha2(normalised(text), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the smallest (or largest) id
    stays. Rows are grouped by a 128-bit hash together with the bytes themselves, so a hash collision cannot join
    different texts; equal rows collapse before the shuffle, so a group of any size costs one row per task.

    Null text counts as empty; empty texts are one group. A null id loses to any other id; in a group of null ids
    only, keep_id is null and all are kept. Rows that repeat an id with equal text share its verdict. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    # Neither hash can be missing: where Spark knows that, the joins below need no filter that would hash all texts again.
    rows = rows.select("id", "body", F.md5("body").alias("hash"), F.coalesce(F.sha2("body", 256), F.lit("")).alias("sha"))
    best = F.min("id") if keep == "smallest" else F.max("id")
    groups = rows.groupBy("hash", "sha", "body").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.col("hash").alias("of_hash"), F.col("sha").alias("of_sha"), "keep_id", "group_size")
    joined = rows.select("id", "hash", "sha").join(groups, (F.col("hash") == F.col("of_hash")) & (F.col("sha") == F.col("of_sha")))
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP2_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
