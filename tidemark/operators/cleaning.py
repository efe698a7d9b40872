"""Validation, deduplication and merging of bars, and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.ranks import quantiles
from tidemark.sources.bars import OHLCV

KEY = ("symbol", "time")


def is_valid_bar() -> Column:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    sound = (F.col("low") <= F.col("high")) & (top <= F.col("high")) & (bottom >= F.col("low"))
    known = F.lit(True)
    for c in ("symbol", "time", *OHLCV[:4]):
        known = known & F.col(c).isNotNull()
    return F.coalesce(known & sound & S.on_grid(F.col("time")), F.lit(False))


def validate_bars(df: DataFrame, sequence: str = "batch", strict: bool = False) -> DataFrame:
    """Sound bars on the five-minute grid, the last of each (symbol, time); strict: a bad row raises an error."""
    good = is_valid_bar()
    if strict:
        checked = F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("a bar breaks the rules")).cast("boolean"))
        return keep_one(df.filter(checked), [F.col(sequence).desc()])
    return keep_one(df.filter(good), [F.col(sequence).desc()])


def quarantine(df: DataFrame) -> DataFrame:
    return df.filter(~is_valid_bar())


def keep_one(df: DataFrame, by: Sequence[Column], key: Sequence[str] = KEY) -> DataFrame:
    """The first row of each key in the order of `by`."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*by))).filter("_rank = 1").drop("_rank")


def ranked_dedupe(raw: DataFrame, sequence: str = "batch") -> DataFrame:
    """One row per (symbol, normalised time): most volume, then widest range, ISO text first, then the latest."""
    iso = F.when(F.col("time").contains("T"), 1).otherwise(0)
    rows = raw.withColumn("_iso", iso).withColumn("time", S.normal_time(F.col("time")))
    best = keep_one(rows, [F.col("volume").desc(), (F.col("high") - F.col("low")).desc(), F.col("_iso").desc(), F.col(sequence).desc()])
    return best.drop("_iso")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, [F.col("_turn").desc()]).drop("_turn")


def insert_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the rows of new whose key old lacks."""
    return old.unionByName(new.join(old.select(*KEY), list(KEY), "left_anti"), allowMissingColumns=True)


def replace_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Drops all rows of the symbols in new, then adds new."""
    return old.join(new.select("symbol").distinct(), "symbol", "left_anti").unionByName(new, allowMissingColumns=True)


def project_to(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def with_column_if_absent(df: DataFrame, name: str = "spread", kind: str = "double") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def gap_report(df: DataFrame, minutes: int = 5, limit: float = 3.0) -> DataFrame:
    """Per symbol: bars, gaps longer than the grid, and rows over `limit` standard deviations for each price."""
    prices = OHLCV[:4]
    stats = df.groupBy("symbol").agg(*(f(c).alias(f"{c}_{n}") for c in prices for f, n in ((F.avg, "m"), (F.stddev_samp, "s"))))
    step = F.unix_timestamp("time") - F.unix_timestamp(F.lag("time").over(W.partitionBy("symbol").orderBy("time")))
    rows = df.withColumn("step", step).join(stats, "symbol")
    far = [F.count_if(F.abs(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s"))) > limit).alias(f"{c}_outliers") for c in prices]
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("step") > 60 * minutes).alias("gaps"), *far)


def duplicate_summary(raw: DataFrame) -> DataFrame:
    """Per symbol: rows, distinct raw and normalised times, surplus rows of both, rows off the grid."""
    rows = raw.withColumn("nt", S.normal_time(F.col("time")))
    off = F.count_if(~S.on_grid(S.to_time(F.col("time"))))
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("time").alias("raw_times"), F.countDistinct("nt").alias("normal_times"), off.alias("off_grid"))
    return out.withColumn("raw_surplus", F.col("total") - F.col("raw_times")).withColumn("normal_surplus", F.col("total") - F.col("normal_times"))


def duplicate_times(raw: DataFrame, limit: int = 50) -> DataFrame:
    """The most repeated (symbol, raw time): count descending, then symbol and time."""
    return raw.groupBy("symbol", "time").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").orderBy(F.desc("c"), "symbol", "time").limit(limit)


def surplus_rows(raw: DataFrame) -> DataFrame:
    """Sum of (count - 1) over repeated (symbol, time) and over repeated whole bars."""
    times = raw.groupBy("symbol", "time").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("time_surplus"))
    whole = raw.groupBy("symbol", "time", *OHLCV).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("bar_surplus"))
    return times.crossJoin(whole)  # one row each


def slot_agreement(raw: DataFrame, digits: int = 10) -> DataFrame:
    """Repeated normalised slots per symbol: with one distinct bar (prices and volume to `digits` places) or several."""
    text = F.concat_ws("|", *(F.format_number(F.col(c), digits) for c in OHLCV))
    slots = raw.groupBy("symbol", S.normal_time(F.col("time")).alias("nt")).agg(F.count(F.lit(1)).alias("c"), F.countDistinct(text).alias("d")).filter("c > 1")
    return slots.groupBy("symbol").agg(F.count_if(F.col("d") == 1).alias("identical"), F.count_if(F.col("d") > 1).alias("differing"))


def sample_duplicates(raw: DataFrame, n: int = 5) -> DataFrame:
    """All rows of the first n repeated (symbol, time)."""
    first = raw.groupBy("symbol", "time").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").orderBy("symbol", "time").limit(n)
    return raw.join(first.select("symbol", "time"), ["symbol", "time"], "left_semi")


def top_duplicate_days(raw: DataFrame, n: int = 5) -> DataFrame:
    """Days with most surplus rows by normalised time."""
    slots = raw.groupBy("symbol", S.normal_time(F.col("time")).alias("nt")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return slots.groupBy(F.substring("nt", 1, 10).alias("day")).agg(F.sum(F.col("c") - 1).alias("surplus")).orderBy(F.desc("surplus"), "day").limit(n)


def latest(df: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("time")))).filter(F.col("_rank") <= n).drop("_rank")


def scan_range(df: DataFrame, symbol: str, start: str, end: str, newest: str | None = None) -> DataFrame:
    """Bars of a symbol with start <= time <= end; the filter reaches the scan where df is a table of bars. newest: a column
    by which the last of the rows that repeat a time stays."""
    found = df.filter((F.col("symbol") == symbol) & F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if newest is None:
        return found
    return found.groupBy("symbol", "time").agg(F.max_by(F.struct("*"), newest).alias("_row")).select("_row.*")


def known_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per symbol: rows, and rows where each column is known."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"known_{c}") for c in columns))


def columns_like(df: DataFrame, word: str) -> list[str]:
    """Columns whose name holds a word."""
    return [c for c in df.columns if word in c]


#: Shares of the quantiles of a description.
QUARTERS = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, value: str = "close", move: Column | None = None, high: float = 0.8, ranges: int | None = None) -> DataFrame:
    """Per symbol: n, mean, std, min, quartiles and max of a column, and p80_move, the `high` quantile of |move|. ranges: quantiles by
    ranges of values (operators.ranks), for series that no task should hold; None where one task a series will do."""
    rows = df.withColumn("_move", F.abs(F.lit(None).cast("double") if move is None else move))
    plain = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    if ranges is None:
        return rows.groupBy("symbol").agg(*plain, *(F.percentile(value, s).alias(c) for c, s in QUARTERS.items()), F.percentile("_move", high).alias("p80_move"))
    levels = quantiles(rows, "symbol", value, list(QUARTERS.values()), ranges).select("symbol", *(F.col("_quantiles")[i].alias(c) for i, c in enumerate(QUARTERS)))
    moves = quantiles(rows, "symbol", "_move", [high], ranges).select("symbol", F.col("_quantiles")[0].alias("p80_move"))
    return rows.groupBy("symbol").agg(*plain).join(levels, "symbol", "left").join(moves, "symbol", "left")
