"""Joins and alignment of series: as-of, carried-forward, interval overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, columns: Sequence[str], on: Sequence[str] = ("symbol",), left_time: str = "time", right_time: str = "time", forward: bool = False, days: int | None = None) -> DataFrame:
    """left with the columns of the newest row of right that is not later (forward: the oldest that is not earlier).

    Both sides are dealt by `on` once, and one sorted pass carries the row of right over, nulls in it included; no rows
    are paired. With `days` they are dealt by spans of so many days too, so that a series is not one task: each span then
    starts from the last row of right before it (forward: the first after it), one small row a span; both sides are read
    twice, so it is meant for stored tables whose series are long.
    """
    value = F.struct(*(F.col(c) for c in columns))
    kind = value_type(right, columns)
    span = lambda at: F.floor(F.unix_seconds(at) / (86400 * days)) if days else F.lit(0).cast("bigint")
    mine = left.select(F.struct("*").alias("_row"), *on, F.col(left_time).alias("_at"), F.lit(None).cast(kind).alias("_value"), F.lit(1).alias("_turn"))
    theirs = right.select(F.lit(None).cast(left.schema.simpleString()).alias("_row"), *on, F.col(right_time).alias("_at"), value.cast(kind).alias("_value"), F.lit(0).alias("_turn"))
    both = mine.union(theirs).withColumn("_span", span(F.col("_at")))
    # Forward, the order is turned round: a frame up to the row grows by one row at a time, one from it on does not.
    near, past = F.last("_value", ignorenulls=True), W.unboundedPreceding
    w = W.partitionBy(*on, "_span").orderBy(F.desc("_at") if forward else F.asc("_at"), "_turn")
    out = both.withColumn("_value", near.over(w.rowsBetween(past, 0))).filter(F.col("_row").isNotNull())
    if days:
        pick = F.min_by if forward else F.max_by
        ends = both.groupBy(*on, "_span").agg(pick("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_value"))
        spans = W.partitionBy(*on).orderBy(F.desc("_span") if forward else F.asc("_span"))
        ends = ends.select(*on, "_span", near.over(spans.rowsBetween(past, -1)).alias("_carried")).filter("_carried IS NOT NULL")
        out = out.join(ends, [*on, "_span"], "left").withColumn("_value", F.coalesce("_value", "_carried"))
    return out.select("_row.*", *(F.col(f"_value.{c}").alias(c) for c in columns))


def value_type(df: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def reindex_forward(clock: DataFrame, series: DataFrame, column: str) -> DataFrame:
    """The series' value at each time of the clock: an exact match, else the last one carried forward. The clock is per
    symbol, the series has one row per time."""
    joined = clock.join(series.select("time", F.col(column).alias("_v")), "time", "left")
    return joined.withColumn(column, F.last("_v", ignorenulls=True).over(W.partitionBy("symbol").orderBy("time").rowsBetween(W.unboundedPreceding, 0))).drop("_v")


def by_previous_day(df: DataFrame, daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of (symbol, day) on bars of the same day, carried over days without one."""
    joined = df.withColumn("day", F.to_date("time")).join(daily, ["symbol", "day"], "left")
    w = W.partitionBy("symbol").orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).drop("day")


def common_rows(first: DataFrame, *others: DataFrame, key: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """Rows of first whose key all others have."""
    for other in others:
        first = first.join(other.select(*key), list(key), "left_semi")
    return first


def with_labels(first: DataFrame, labels: DataFrame, key: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """All rows of first with the columns of labels that it does not have itself; null where labels have no such row."""
    return first.join(labels.select(*key, *(c for c in labels.columns if c not in first.columns)), list(key), "left")


def event_flag(df: DataFrame, events: DataFrame, name: str, key: Sequence[str] = ("symbol", "time")) -> DataFrame:
    marked = events.select(*key).distinct().withColumn(name, F.lit(1))
    return df.join(marked, list(key), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def purge(train: DataFrame, spans: DataFrame, on: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows of train (t0, t1) that overlap none of the spans (start, end), ends included."""
    a, b = train.alias("a"), spans.alias("b")
    overlap = (F.col("a.t0") <= F.col("b.end")) & (F.col("a.t1") >= F.col("b.start"))
    for c in on:
        overlap = overlap & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, overlap, "left_anti")


def last_per_key(df: DataFrame, key: Sequence[str], by: str) -> DataFrame:
    """The row of each key with the largest `by`."""
    best = df.groupBy(*key).agg(F.max_by(F.struct("*"), by).alias("_row"))
    return best.select("_row.*")
