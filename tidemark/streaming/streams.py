"""Structured Streaming twins: bars and distinct ticks that merge, bars with late data, idempotent upserts, stateful kernels.

Bars and distinct ticks need no order of arrival and no watermark: every micro-batch is summed up by itself, and the sums
merge by functions that take them in any order (first, last, highest, lowest, sum). So it makes no difference how ticks
are dealt to files and files to batches, and nothing is late. What runs along a series (exponential means, cumulative
sums) does need order: its ticks must arrive in the order of time from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.bars import OHLCV, resample
from tidemark.sources.shared import work_folder

def watch(spark: SparkSession, path: str, schema, per_trigger: int = 256 << 20) -> DataFrame:
    """The files that are at a path (a folder, or a pattern of folders and files) or arrive there, as a stream; a micro-batch takes about so
    many bytes of them, which bounds the rows that a group's state is given at once."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", per_trigger).parquet(path)


def tick_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 256 << 20) -> DataFrame:
    """The events table, one file or a folder of them, as a stream of ticks; event times become timestamps, as watermarks
    need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = watch(spark, f"{sf_dir}/events.parque[t]", schema, per_trigger)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def bar_stream(ticks: DataFrame, late: str = "1 hour", width: str = "5 minutes") -> DataFrame:
    """Five-minute bars of a stream of ticks; later ticks than `late` are dropped with their bar closed."""
    return resample(ticks.withWatermark("ts", late), width)


def bar_parts(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """What a batch of ticks adds to each bar: its first and last tick, highest and lowest value and volume."""
    tick = F.struct("ts", "event_id", "value")
    parts = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min(tick).alias("first"), F.max(tick).alias("last"), F.max("value").alias("high"), F.min("value").alias("low"), F.sum("k").alias("volume"))
    return parts.select("symbol", F.col("w.start").alias("time"), "first", "last", "high", "low", "volume")


def merged_bars(parts: DataFrame) -> DataFrame:
    """Bars from any number of parts of each, in any order; parts merge before they are shuffled."""
    out = parts.groupBy("symbol", "time").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    return out.select("symbol", "time", F.col("first.value").alias("open"), "high", "low", F.col("last.value").alias("close"), "volume").select("symbol", "time", *OHLCV)


def distinct_parts(ticks: DataFrame) -> DataFrame:
    """The earliest tick of each id; parts merge by the same function."""
    first = F.min(F.struct("ts", *(c for c in ticks.columns if c not in ("ts", "event_id"))))
    return ticks.groupBy("event_id").agg(first.alias("t")).select("event_id", "t.*")


def merge_sink(stream: DataFrame, folder: str, checkpoint: str, part: Callable[[DataFrame], DataFrame]):
    """Writes what part() makes of each micro-batch to a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def run_merged(stream: DataFrame, name: str, part: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over what is there now and merges the parts of all its micro-batches; of no batch there are no rows."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    query = merge_sink(stream, f"{folder}/rows", f"{folder}/checkpoint", part)
    query.awaitTermination()
    kind = part(spark.createDataFrame([], stream.schema)).schema
    if query.lastProgress is None:
        return merge(spark.createDataFrame([], kind))
    return merge(spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(f"{folder}/rows"))


def streamed_bars(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    return run_merged(ticks, "bars", lambda batch: bar_parts(batch, width), merged_bars)


def streamed_distinct(ticks: DataFrame) -> DataFrame:
    """Ticks without repeated ids, whatever the distance between two with the same id; the earliest of them stays."""
    return run_merged(ticks, "ticks", distinct_parts, distinct_parts)


def upsert_sink(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update"):
    """Writes each micro-batch to a folder of its own, so that a repeated batch replaces itself; read with current()."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current(spark: SparkSession, folder: str, schema, key: tuple[str, ...] = ("symbol", "time"), condition: str = "true") -> DataFrame:
    """The newest row of each key over all batches, of rows that meet a condition."""
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).option("basePath", folder).parquet(f"{folder}/*").filter(condition)
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("batch")))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "batch")


def run_to_table(stream: DataFrame, name: str, key: tuple[str, ...], mode: str = "update") -> DataFrame:
    """Runs a stream over what is there now and returns the newest row of each key."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    upsert_sink(stream, f"{folder}/rows", f"{folder}/checkpoint", mode).awaitTermination()
    kind = stream.schema
    return current(spark, f"{folder}/rows", kind, key)


def distinct_ticks(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Ticks without repeated ids within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running(ticks: DataFrame, columns: dict[str, str], start: tuple, step: Callable[[tuple, float], tuple[tuple, tuple]]) -> DataFrame:
    """Arbitrary state per symbol: step(state, value) gives the next state and the row's new columns. Within a micro-batch
    rows go in the order of (ts, event_id), for which a task holds a symbol's rows of that batch (see watch); streamed_running
    does not."""
    kinds = ", ".join(f"s{i} double" for i in range(len(start)))
    out = "symbol string, ts timestamp, event_id long, " + ", ".join(f"{c} {t}" for c, t in columns.items())

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        found = []
        for v in rows["value"]:
            now, new = step(tuple(now), float(v))
            found.append(new)
        state.update(tuple(map(float, now)))
        yield pd.concat([rows[["symbol", "ts", "event_id"]].reset_index(drop=True), pd.DataFrame(found, columns=list(columns))], axis=1)

    return ticks.groupBy("symbol").applyInPandasWithState(update, out, kinds, "append", GroupStateTimeout.NoTimeout)


def streamed_running(ticks: DataFrame, name: str, columns: dict[str, str], start: tuple, step: Callable[[tuple, float], tuple[tuple, tuple]]) -> DataFrame:
    """What running() gives, run over what is there now, with memory that does not grow with a micro-batch: each is dealt by
    symbol and sorted, and one pass takes the sorted rows a piece at a time. A symbol's state is a row before its ticks; the
    pass leaves the last ones for the next batch, so a repeated batch starts from the same states and replaces itself."""
    spark = ticks.sparkSession
    folder = work_folder(spark, name)
    states, keys = [f"s{i}" for i in range(len(start))], ["symbol", "ts", "event_id"]
    held = "symbol string, " + ", ".join(f"{s} double" for s in states)
    kind = f"{held}, ts timestamp, event_id long, is_state boolean, " + ", ".join(f"{c} {t}" for c, t in columns.items())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = lambda found: pd.DataFrame(found, columns=["symbol", *states]).assign(ts=pd.NaT, event_id=0, is_state=True, **dict.fromkeys(columns, 0))
        begun, symbol, now = False, None, tuple(start)
        for rows in parts:
            is_state, found, ended = rows["is_state"].to_numpy(bool), [], []
            for s, carried, v, *state in zip(rows["symbol"], is_state, rows["value"], *(rows[c] for c in states), strict=True):
                if not begun or s != symbol:
                    ended += [(symbol, *now)] if begun else []
                    begun, symbol, now = True, s, tuple(start)
                if carried:
                    now = tuple(state)
                else:
                    now, new = step(tuple(now), float(v))
                    found.append(new)
            if found:
                mine = rows.loc[~is_state, keys].reset_index(drop=True)
                yield pd.concat([mine, pd.DataFrame(found, columns=list(columns))], axis=1).assign(is_state=False, **dict.fromkeys(states, float("nan")))
            if ended:
                yield last(ended)
        if begun:
            yield last([(symbol, *now)])

    def write(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        rows = batch.select(*keys, F.col("value").cast("double").alias("value"), F.lit(False).alias("is_state"), *(F.lit(None).cast("double").alias(s) for s in states))
        if number:
            before = here.read.schema(held).parquet(f"{folder}/states/batch={number - 1}")
            rows = rows.union(before.select("symbol", F.lit(None).cast("timestamp"), F.lit(0).cast("long"), F.lit(None).cast("double"), F.lit(True), *states))
        ordered = rows.repartition("symbol").sortWithinPartitions("symbol", F.desc("is_state"), F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
        ordered.mapInPandas(run, kind).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        here.read.schema(kind).parquet(f"{folder}/rows/batch={number}").filter("is_state").select("symbol", *states).write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    query = ticks.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = spark.createDataFrame([], kind).schema
    out = spark.createDataFrame([], schema) if query.lastProgress is None else current(spark, f"{folder}/rows", schema, ("event_id",), "NOT is_state")
    return out.select(*keys, *columns)


def _ema(n: int) -> tuple[dict[str, str], tuple, Callable]:
    alpha = 2 / (n + 1)

    def step(state: tuple, v: float) -> tuple[tuple, tuple]:
        seen, mean = state
        mean = v if not seen else mean + alpha * (v - mean)
        return (1.0, mean), (mean,)

    return {"ema": "double"}, (0.0, 0.0), step


def _cusum(k: float, centre: float) -> tuple[dict[str, str], tuple, Callable]:
    def step(state: tuple, v: float) -> tuple[tuple, tuple]:
        up, down = max(0.0, state[0] + v - centre), min(0.0, state[1] + v - centre)
        hit = up > k or down < -k
        return ((0.0, 0.0) if hit else (up, down)), (int(hit),)

    return {"event": "int"}, (0.0, 0.0), step


def running_ema(ticks: DataFrame, n: int = 20) -> DataFrame:
    """Exponential mean of values with alpha 2 / (n + 1) from the first tick on."""
    return running(ticks, *_ema(n))


def running_cusum(ticks: DataFrame, k: float, centre: float) -> DataFrame:
    """Events of the two-sided cumulative sum of value - centre beyond k."""
    return running(ticks, *_cusum(k, centre))


def streamed_ema(ticks: DataFrame, n: int = 20) -> DataFrame:
    """running_ema over what is there now, in bounded memory."""
    return streamed_running(ticks, "ema", *_ema(n))


def streamed_cusum(ticks: DataFrame, k: float, centre: float) -> DataFrame:
    """running_cusum over what is there now, in bounded memory."""
    return streamed_running(ticks, "cusum", *_cusum(k, centre))
