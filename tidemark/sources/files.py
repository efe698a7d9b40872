"""Files and catalog: CSV bars of several shapes, symbol partitions, reports, table discovery, samples."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions import scalars as S
from tidemark.operators import cleaning
from tidemark.operators.cleaning import keep_one

DELIMITERS = ",;\t|"
PLAIN = ["date", "clock", "open", "high", "low", "close", "tick_volume", "volume", "spread"]


def sniff(spark: SparkSession, path: str) -> str:
    """The most frequent delimiter of the first line; a comma where there is none."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(DELIMITERS, key=lambda d: (line.count(d), d == ","))


def read_headed_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars from a CSV with a header in any case: date and time, or datetime, timestamp or time; volume or vol. Rows without
    a time on the grid are dropped; of repeated times the first stays."""
    raw = spark.read.csv(path, sep=sniff(spark, path), header=True)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    has = raw.columns
    if "date" in has and "time" in has:
        time = S.combine(S.parse_date(F.col("date")), S.parse_clock(F.col("time")))
    else:
        name = next((c for c in ("datetime", "timestamp", "time") if c in has), None)
        if name is None:
            raise ValueError(f"{path} has no column of times")
        whole = S.to_time(F.col(name))
        time = F.when(S.on_grid(whole), whole)
    volume = next((F.col(c) for c in ("volume", "vol") if c in has), F.lit(None).cast("string"))
    out = raw.select((F.col("symbol") if "symbol" in has else F.lit(symbol)).alias("symbol"), time.alias("time"), *(S.safe_float(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), S.safe_float(volume).alias("volume"), F.monotonically_increasing_id().alias("_row"))
    return keep_one(out.filter("time IS NOT NULL"), [F.col("_row")]).drop("_row")


def read_plain_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars from a CSV of nine columns without a header; rows whose time cannot be read are dropped."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in PLAIN)).csv(path)
    time = F.coalesce(*(F.try_to_timestamp(F.concat_ws(" ", "date", "clock"), F.lit(f)) for f in ("yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")))
    out = raw.select(F.lit(symbol).alias("symbol"), time.alias("time"), *(S.safe_float(F.col(c)).alias(c) for c in PLAIN[2:]), F.monotonically_increasing_id().alias("_row"))
    return keep_one(out.filter("time IS NOT NULL"), [F.col("_row")]).drop("_row")


def replace_partitions(df: DataFrame, path: str) -> None:
    """Writes a store of bars by symbol; the symbols in df are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def merge_partitions(spark: SparkSession, new: DataFrame, path: str, work: str) -> None:
    """Adds new rows to a store of bars by symbol: where both have a (symbol, time), the new row stays. Columns are those of
    the store. Only the symbols in new are read and written, by way of the folder `work`, as a store cannot be read
    while it is replaced."""
    old = spark.read.parquet(path)
    touched = old.join(new.select("symbol").distinct(), "symbol", "left_semi")
    cleaning.upsert(touched, cleaning.project_to(new, old.columns)).write.mode("overwrite").parquet(work)
    replace_partitions(spark.read.parquet(work), path)


def stored(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """A store's bars, or those of one symbol: its partition alone is read."""
    rows = spark.read.parquet(path)
    return rows if symbol is None else rows.filter(F.col("symbol") == symbol)


def snapshot(spark: SparkSession, path: str, to: str) -> None:
    """A copy of a store before it is changed."""
    spark.read.parquet(path).write.parquet(to)


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small table as one CSV or JSON file."""
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def inspect(spark: SparkSession) -> DataFrame:
    """Tables and views of the catalog with their columns and numbers of rows."""
    found = [(t.name, t.isTemporary, [c.name for c in spark.catalog.listColumns(t.name)], spark.table(t.name).count()) for t in spark.catalog.listTables()]
    return spark.createDataFrame(found, "name string, temporary boolean, columns array<string>, rows long")


def timeframes(df: DataFrame) -> DataFrame:
    """What a table of bars holds, by symbol and timeframe (null where df has no such column): rows, and the first and last time."""
    at = next(c for c in df.columns if c.lower() in ("time", "timestamp", "datetime"))
    frame = F.col("timeframe").cast("string") if "timeframe" in df.columns else F.lit(None).cast("string")
    return df.groupBy("symbol", frame.alias("timeframe")).agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))


def bar_tables(spark: SparkSession) -> list[str]:
    """Tables that look like five-minute bars: by name or timeframe, and with a time and prices."""
    out = []
    for t in spark.catalog.listTables():
        columns = {c.name.lower() for c in spark.catalog.listColumns(t.name)}
        named = any(k in t.name.lower() for k in ("m5", "5min", "5m")) or "timeframe" in columns
        if named and columns & {"time", "timestamp", "datetime"} and {"open", "close"} <= columns:
            out.append(t.name)
    return sorted(out)


def clear_tables(spark: SparkSession, words: tuple[str, ...] = ("feature", "label")) -> list[str]:
    """Drops tables (not views) whose name or a column's name holds one of the words; returns their names."""
    gone = []
    for t in spark.catalog.listTables():
        names = [t.name, *(c.name for c in spark.catalog.listColumns(t.name))]
        if not t.isTemporary and any(w in n.lower() for w in words for n in names):
            spark.sql(f"DROP TABLE `{t.name}`")
            gone.append(t.name)
    return gone


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows that the seed and the key choose, the same in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col("symbol"), F.col("time").cast("string")), "symbol", "time").limit(n)


class BrokerReader(DataSourceReader):
    """Reads a dry run's bars, some thousand a partition."""

    def __init__(self, options: dict[str, str]):
        self.symbol, self.count, self.end = options["symbol"], int(options["count"]), options.get("end", "2024-01-01 00:00:00")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + 5000, self.count))) for a in range(0, self.count, 5000)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        end = datetime.fromisoformat(self.end).replace(tzinfo=UTC)
        for i in range(*partition.value):
            yield (self.symbol, end - timedelta(minutes=5 * (self.count - 1 - i)), 1.0, 1.1, 0.9, 1.05, 100.0)


class Broker(DataSource):
    """Bars of a broker as a data source: spark.read.format("broker").option("symbol", ...).option("count", ...). Only dry runs
    are here: constant bars on the five-minute grid up to a time; a connection takes the place of the reader."""

    @classmethod
    def name(cls) -> str:
        return "broker"

    def schema(self) -> str:
        return "symbol string, time timestamp, open double, high double, low double, close double, tick_volume double"

    def reader(self, schema) -> DataSourceReader:
        return BrokerReader(self.options)


def broker_bars(spark: SparkSession, symbol: str, count: int) -> DataFrame:
    spark.dataSource.register(Broker)
    return spark.read.format("broker").option("symbol", symbol).option("count", count).load()
