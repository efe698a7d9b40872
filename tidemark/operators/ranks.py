"""Exact quantiles and ranks of long series: rows are dealt to ranges of values, so that no task sorts a whole series.

A mergeable sketch gives each key some values that part its rows about evenly. Every row belongs to the range between two
of them, or to one of them by itself, which keeps a value that very many rows share apart. Counts of ranges, one small
row each, say how many rows come before a range; a quantile then only sorts the ranges that hold it, and a rank is a
row's place in its range plus what comes before it. Ranges of one value hold equal rows, which go by day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import work_folder

#: Ranges that the rows of a key are dealt to.
RANGES = 64


def in_ranges(df: DataFrame, by: str, value: str, ranges: int = RANGES) -> DataFrame:
    """Known values of df with _range: even numbers between the parting values of a key, odd ones at them. The parting values,
    one row a key, are written first; Spark sees their size and broadcasts them or not."""
    known = df.filter(F.col(value).isNotNull())
    cuts = known.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    folder = work_folder(df.sparkSession, "ranges")
    cuts.withColumn("_cuts", F.sort_array(F.array_distinct("_cuts"))).write.parquet(folder)
    placed = known.join(df.sparkSession.read.schema(cuts.schema).parquet(folder), F.col(by) == F.col("_by"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return placed.withColumn("_range", 2 * below + F.array_contains("_cuts", F.col(value)).cast("int")).drop("_by", "_cuts")


def _before(counts: DataFrame, by: str, *order: str) -> DataFrame:
    """Counts (_n) with the rows of ranges before each and of the whole key."""
    so_far = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0))).withColumn("_of", F.sum("_n").over(W.partitionBy(by)))


def quantiles(df: DataFrame, by: str, value: str, shares: Sequence[float], ranges: int = RANGES) -> DataFrame:
    """One row a key with known values: _quantiles, the interpolated quantiles of value (a double) at each share, as an array in
    the order of shares."""
    placed = in_ranges(df.select(by, F.col(value).cast("double").alias("_v")), by, "_v", ranges)
    counts = _before(placed.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n")), by, "_range")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)))
    at = F.col("_w.share") * (F.col("_of") - 1)
    places = counts.withColumn("_w", F.explode(wanted)).withColumn("_part", at - F.floor(at))
    places = places.withColumn("_at", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))))
    places = places.filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_n")))
    places = places.select(by, "_range", F.col("_w.i").alias("_i"), "_part", "_at", "_before")
    held = placed.join(places.select(by, "_range", "_before").distinct(), [by, "_range"])
    # A range of one value has it at all its places, so its rows need no order; one row stands for them.
    single = held.filter("_range % 2 = 1").groupBy(by, "_range").agg(F.first("_v").alias("_v"))
    sorted_rows = held.filter("_range % 2 = 0").withColumn("_at", F.col("_before") + F.row_number().over(W.partitionBy(by, "_range").orderBy("_v")) - 1)
    found = places.filter("_range % 2 = 1").join(single, [by, "_range"]).select(by, "_i", "_part", "_at", "_v")
    found = found.unionByName(places.filter("_range % 2 = 0").drop("_before").join(sorted_rows.select(by, "_range", "_at", "_v"), [by, "_range", "_at"]).select(by, "_i", "_part", "_at", "_v"))
    low, high = F.min_by("_v", "_at"), F.max_by("_v", "_at")
    each = found.groupBy(by, "_i").agg((low + F.first("_part") * (high - low)).alias("_q"))
    return each.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("_quantiles"))


def ranks(df: DataFrame, by: str, value: str, time: str = "time", ranges: int = RANGES) -> DataFrame:
    """Rows of df with a known value, with _rank from 1 in the order of value and then time within each key, and _of, the rows
    of the key."""
    day = F.when(F.col("_range") % 2 == 1, F.to_date(time))
    placed = in_ranges(df, by, value, ranges).withColumn("_day", F.coalesce(day, F.lit("1970-01-01").cast("date")))
    counts = _before(placed.groupBy(by, "_range", "_day").agg(F.count(F.lit(1)).alias("_n")), by, "_range", "_day").drop("_n")
    place = F.row_number().over(W.partitionBy(by, "_range", "_day").orderBy(value, time))
    out = placed.withColumn("_place", place).join(counts, [by, "_range", "_day"])
    return out.withColumn("_rank", F.col("_before") + F.col("_place")).select(*df.columns, "_rank", "_of")


def tile(rank, of, bins: int):
    """The number from 0 of the bin of a rank where `of` rows are dealt to equal bins, the first of % bins one longer."""
    size, more = F.floor(of / bins), of % bins
    edge = (size + 1) * more
    return F.when(rank - 1 < edge, F.floor((rank - 1) / (size + 1))).otherwise(more + F.floor((rank - 1 - edge) / F.greatest(size, F.lit(1)))).cast("int")
