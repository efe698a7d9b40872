"""Windows over bars: row frames with minimum counts, and chunks with a halo for very long series."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import kernels as K

PART = ("symbol",)


def order(part: Sequence[str] = PART, time: str = "time"):
    return W.partitionBy(*part).orderBy(time)


def last_rows(n: int, part: Sequence[str] = PART):
    """The row and the n - 1 before it."""
    return order(part).rowsBetween(1 - n, 0)


def next_rows(n: int, part: Sequence[str] = PART):
    """The n rows after the row."""
    return order(part).rowsBetween(1, n)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, least: int | None = None, part: Sequence[str] = PART) -> Column:
    """agg of x over the last n rows where at least `least` (n if not given) of them are not null."""
    frame = last_rows(n, part)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def mean(x: Column, n: int, least: int | None = None, part: Sequence[str] = PART) -> Column:
    return rolling(F.avg, x, n, least, part)


def std(x: Column, n: int, least: int | None = None, part: Sequence[str] = PART) -> Column:
    return rolling(F.stddev_samp, x, n, least, part)


def lag(x: Column | str, n: int = 1, part: Sequence[str] = PART) -> Column:
    return F.lag(x, n).over(order(part))


def diff(x: Column | str, part: Sequence[str] = PART) -> Column:
    return (F.col(x) if isinstance(x, str) else x) - lag(x, 1, part)


def divide(a: Column, b: Column, over_zero: bool = False) -> Column:
    """a / b, unknown where b is 0; with over_zero it is what doubles give there: infinite with the sign of a, NaN for 0 / 0."""
    known = F.try_divide(a, b)
    return F.when(b == 0, a * float("inf")).otherwise(known) if over_zero else known


def sign(x: Column) -> Column:
    """-1.0, 0.0 or 1.0; NaN has no sign and is 0."""
    return F.when(F.isnan(x), 0.0).otherwise(F.signum(x))


def pct_change(x: str, n: int = 1, part: Sequence[str] = PART, over_zero: bool = False) -> Column:
    return divide(F.col(x), lag(x, n, part), over_zero) - 1


def log_change(x: str, part: Sequence[str] = PART, over_zero: bool = False) -> Column:
    """Change of the logarithm, unknown where x or the value before is 0; with over_zero the logarithm of 0 is minus infinity."""
    log = lambda c: F.when(c == 0, float("-inf")).otherwise(F.ln(c)) if over_zero else F.ln(c)
    return log(F.col(x)) - log(lag(x, 1, part))


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def fill_forward(x: Column, part: Sequence[str] = PART) -> Column:
    return F.last(x, ignorenulls=True).over(order(part).rowsBetween(W.unboundedPreceding, 0))


def running_product(x: Column, part: Sequence[str] = PART) -> Column:
    """Product of the values so far, of any sign: their sizes are added up as logarithms, a zero makes all that follows zero."""
    frame = order(part).rowsBetween(W.unboundedPreceding, 0)
    size = F.exp(F.coalesce(F.sum(F.ln(F.nullif(F.abs(x), F.lit(0.0)))).over(frame), F.lit(0.0)))
    sign = F.when(F.sum((x < 0).cast("int")).over(frame) % 2 == 1, -size).otherwise(size)
    return F.when(F.max((x == 0).cast("int")).over(frame) == 1, 0.0).otherwise(sign)


def row_numbers(df: DataFrame, part: Sequence[str] = PART, name: str = "rn") -> DataFrame:
    """Numbers the rows of each series from 1 in the order of time, by counts of days and then within each day, so that
    no task needs a whole series. A column of that name is taken to be the numbers already."""
    if name in df.columns:
        return df
    day = F.to_date("time")
    keyed = df.withColumn("_day", day)
    counts = keyed.groupBy(*part, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*part).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    within = F.row_number().over(W.partitionBy(*part, "_day").orderBy("time"))
    return keyed.join(starts, [*part, "_day"]).withColumn(name, (F.col("_before") + within).cast("bigint")).drop("_day", "_before")


def in_chunks(df: DataFrame, feature: Callable[[DataFrame, Sequence[str]], DataFrame], halo: int = 0, ahead: int = 0, rows: int = 100_000) -> DataFrame:
    """Applies a feature over fixed row frames to chunks of each series instead of whole series.

    Every chunk gets the `halo` rows before it and the `ahead` rows after it, so frames that reach so far (nested frames:
    their sum) see what they would see in the whole series; the feature is called with the columns that name a chunk.
    """
    if max(halo, ahead) >= rows:
        raise ValueError("a chunk must be longer than its halo")
    given = "rn" in df.columns
    numbered = row_numbers(df)
    own, place = F.floor((F.col("rn") - 1) / rows), (F.col("rn") - 1) % rows
    chunks = F.array(own, F.when(place >= rows - halo, own + 1), F.when((place < ahead) & (own > 0), own - 1))
    spread = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(F.array_compact(chunks)))
    out = feature(spread, ("symbol", "_chunk"))
    return out.filter("_own = _chunk").drop("_own", "_chunk", *([] if given else ["rn"]))


def over_past(df: DataFrame, value: Column, columns: Sequence[str], kernel: Callable[..., Sequence[np.ndarray]], part: Sequence[str] = PART, rows: int = 4096, needed: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Adds columns that depend on all rows of a series up to each one: kernel(y, first) gives them at rows first.. of y.

    A series is cut into chunks; each chunk's task gets the values of its own and all earlier chunks (8 bytes a row), so
    the tasks of one series run side by side. Missing values are NaN in y. With `needed`, only those of earlier chunks go
    along that needed(values) says can matter to a later row (and the first and last, so that changes between chunks are
    known); others are NaN in y, too, and kernel(y, first, before) gets the sum and the number of all squared changes up
    to row first - 1.
    """
    given = df.columns
    numbered = row_numbers(df.withColumn("_v", value.cast("double")), part).withColumn("_chunk", F.floor((F.col("rn") - 1) / rows))
    packed = F.sort_array(F.collect_list(F.struct("rn", F.coalesce("_v", F.lit(float("nan"))).alias("v"))))
    blocks = numbered.groupBy(*part, "_chunk").agg(F.transform(packed, lambda x: x["v"]).alias("_y"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in blocks.select(*part, "_chunk").dtypes)

    def reduced(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for p in parts:
            found = []
            for y in (np.asarray(x, float) for x in p["_y"]):
                keep = np.ones(len(y), bool) if needed is None else needed(y)
                keep[[0, -1]] = True
                found.append((np.flatnonzero(keep), y[keep], *K.squared_changes(y)))
            yield p[[*part, "_chunk"]].assign(**{c: [x[i] for x in found] for i, c in enumerate(("_at", "_kept", "_sum", "_count"))})

    past = blocks.mapInPandas(reduced, f"{kinds}, _at array<long>, _kept array<double>, _sum double, _count long")
    past = past.withColumnRenamed("_chunk", "_block").withColumn("_last", F.max("_block").over(W.partitionBy(*part))).filter("_block < _last")
    past = past.select(*(F.col(c).alias(f"_of_{c}") for c in part), "_block", "_at", "_kept", "_sum", "_count", F.explode(F.sequence(F.col("_block") + 1, "_last")).alias("_of_chunk"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}` double" for c in columns)])

    def run(own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("rn")
        first = rows * len(before)
        y = np.append(np.full(first, np.nan), own["_v"].astype(float).to_numpy())
        for b, at, kept in zip(before["_block"], before["_at"], before["_kept"], strict=True):
            y[b * rows + np.asarray(at, np.int64)] = kept
        seams = np.arange(rows, first, rows)
        steps = (y[seams] - y[seams - 1]) ** 2
        known = ~np.isnan(steps)
        sums = float(before["_sum"].sum() + steps[known].sum()), int(before["_count"].sum() + known.sum())
        return own[given].assign(**dict(zip(columns, kernel(y, first) if needed is None else kernel(y, first, sums), strict=True)))

    out = numbered.groupBy(*part, "_chunk").cogroup(past.groupBy(*(f"_of_{c}" for c in part), "_of_chunk")).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
