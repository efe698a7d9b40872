"""Bars from events and orders, and deterministic dirty bars for the cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OHLCV = ["open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def resample(rows: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Open, high, low, close and volume of ticks (symbol, ts, event_id, value, k) in left-closed buckets."""
    at = F.struct("ts", "event_id")
    out = rows.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("k").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("time"), *OHLCV)


def bars(spark: SparkSession, sf_dir: str, width: str = "5 minutes") -> DataFrame:
    return resample(ticks(spark, sf_dir), width)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders: priority as the symbol, total price as the value."""
    orders = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate").cast("timestamp").alias("time")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), day).agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def dirty_bars(clean: DataFrame) -> DataFrame:
    """Bars as raw text rows (time as text, batch as the ingestion order) with ISO copies, altered copies and off-grid rows."""
    plain, iso = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"

    def part(rows: DataFrame, shape: str, batch: int, more: float = 0.0) -> DataFrame:
        return rows.select("symbol", F.date_format("time", shape).alias("time"), *OHLCV[:4], (F.col("volume") + more).alias("volume"), F.lit(batch).alias("batch"))

    minute = F.minute("time")
    late = clean.filter(F.hour("time") == 3).withColumn("time", F.col("time") + F.expr("INTERVAL 1 MINUTE"))
    out = part(clean, plain, 0).union(part(clean.filter(minute % 15 == 0), iso, 1))
    return out.union(part(clean.filter(minute % 20 == 0), plain, 2, 10.0)).union(part(late, plain, 3))
