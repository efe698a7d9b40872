"""Registered queries of the bar operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Views that the SQL of queries builds on; bars are derived from events as in tidemark.sources.bars.
BARS = """
ticks AS (SELECT event_type AS symbol, ts, event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
bars AS MATERIALIZED (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(k) AS volume FROM ticks GROUP BY ALL)"""
H1 = """
bars_h1 AS MATERIALIZED (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(k) AS volume FROM ticks GROUP BY ALL)"""
DAILY = """
daily AS MATERIALIZED (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS time, arg_min(o_totalprice, o_orderkey) AS open,
  max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL)"""
DIRTY = """
dirty AS MATERIALIZED (
  SELECT symbol, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, open, high, low, close, volume, 0 AS batch FROM bars
  UNION ALL SELECT symbol, strftime(time, '%Y-%m-%dT%H:%M:%S') || '+00:00', open, high, low, close, volume, 1 FROM bars WHERE minute(time) % 15 = 0
  UNION ALL SELECT symbol, strftime(time, '%Y-%m-%d %H:%M:%S'), open, high, low, close, volume + 10, 2 FROM bars WHERE minute(time) % 20 = 0
  UNION ALL SELECT symbol, strftime(time + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S'), open, high, low, close, volume, 3 FROM bars WHERE hour(time) = 3)"""


def plain_session(spark: SparkSession) -> None:
    """Times of bars are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def register(name: str, build: Callable[[SparkSession, str], DataFrame], keys: Sequence[str], doubles: Sequence[str] = (), sql: str | None = None, views: Sequence[str] = (BARS,), digits: int = 6) -> None:
    """Adds a query: keys as they are (timestamps without zone), doubles rounded, and the SQL with the same rounding (the scaled
    double, not its decimal text, which rounds some halves the other way)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        plain_session(spark)
        df = build(spark, sf_dir)
        kinds = dict(df.dtypes)
        same = [F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" else F.col(c) for c in keys]
        return df.select(*same, *((F.round(F.col(c) * 10.0**digits) / 10.0**digits + F.lit(0.0)).alias(c) for c in doubles))

    QUERIES[name] = query
    if sql is not None:
        columns = ", ".join([*keys, *(f"round({c}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles)])
        ctes = ", ".join(v.strip() for v in views)
        SQL[name] = f"WITH RECURSIVE {ctes + ', ' if ctes else ''}result_rows AS ({sql}) SELECT {columns} FROM result_rows"


from tidemark.plans import bar_queries, label_queries, model_queries  # noqa: E402, F401
