"""Validation splits as long tables (symbol, split, role, row): row counts from 0 in the order of time."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.windows import row_numbers


def _rows(df: DataFrame) -> DataFrame:
    return row_numbers(df, name="_rn").withColumn("row", F.col("_rn") - 1).drop("_rn")


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def walk_forward(df: DataFrame, train: int, embargo: int, test: int, step: int) -> DataFrame:
    """Moving train and test blocks with a gap between them; the last block that does not fit is left out. Each row is
    expanded to the splits that hold it, so nothing is joined but the length of its series."""
    last = F.floor((F.col("n") - train - embargo - test) / step)
    rows = _rows(df).join(_sizes(df), "symbol").filter(F.col("n") >= train + embargo + test).withColumn("_last", last)

    def role(name: str, start: int, length: int) -> DataFrame:
        low = F.greatest(F.lit(0), F.ceil((F.col("row") - start - length + 1) / step))
        high = F.least(F.col("_last"), F.floor((F.col("row") - start) / step))
        held = rows.filter((low <= high) & (F.col("row") >= start))
        return held.select("symbol", F.explode(F.sequence(low, high)).alias("split"), F.lit(name).alias("role"), "row")

    return role("train", 0, train).unionByName(role("test", train + embargo, test))


def expanding(df: DataFrame, splits: int) -> DataFrame:
    """Time-series splits: each of the last `splits` equal blocks is tested after all rows before it."""
    rows = _rows(df).join(_sizes(df), "symbol").withColumn("_size", F.floor(F.col("n") / (splits + 1)))
    start = F.col("n") - (splits - F.col("split")) * F.col("_size")
    out = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("_start", start)
    role = F.when(F.col("row") < F.col("_start"), "train").when(F.col("row") < F.col("_start") + F.col("_size"), "test")
    return out.withColumn("role", role).filter("role IS NOT NULL").select("symbol", "split", "role", "row")


def tail_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """The first share of each series to train, the rest to test."""
    rows = _rows(df).join(_sizes(df), "symbol")
    return rows.select("symbol", F.lit(0).alias("split"), F.when(F.col("row") < F.floor(F.col("n") * share), "train").otherwise("test").alias("role"), "row")


def folds(df: DataFrame, k: int) -> DataFrame:
    """Equal folds in the order of time; the first n % k are one longer."""
    rows = _rows(df).join(_sizes(df), "symbol")
    size, more = F.floor(F.col("n") / k), F.col("n") % k
    edge = (size + 1) * more
    fold = F.when(F.col("row") < edge, F.floor(F.col("row") / (size + 1))).otherwise(more + F.floor((F.col("row") - edge) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("n")


def stratified_folds(df: DataFrame, k: int, label: str) -> DataFrame:
    """Folds in the order of time within each class, so that all have the same mix."""
    w = W.partitionBy("symbol", label).orderBy("time")
    n = F.count(F.lit(1)).over(W.partitionBy("symbol", label))
    rows = _rows(df).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    edge = (size + 1) * more
    fold = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (size + 1))).otherwise(more + F.floor((F.col("_i") - edge) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("_i", "_n")


def _purged(rows: DataFrame, tests: DataFrame, spans: DataFrame, embargo: str) -> DataFrame:
    """Training rows of each split: those whose [time, t1] overlaps no span of it and that do not start within the embargo
    after one. spans: symbol, split, start, end; one row a symbol and split, so the join multiplies rows by the splits."""
    clear = (F.col("r.t1") < F.col("s.start")) | (F.col("r.time") >= F.col("s.end") + F.expr(embargo)) & (F.col("r.time") > F.col("s.end"))
    pairs = rows.alias("r").join(spans.alias("s"), F.col("r.symbol") == F.col("s.symbol"))
    train = pairs.groupBy("r.symbol", "s.split", "r.row").agg(F.min(F.coalesce(clear, F.lit(False)).cast("int")).alias("ok")).filter("ok = 1")
    return train.select("symbol", "split", F.lit("train").alias("role"), "row").join(tests.select("symbol", "split", "row"), ["symbol", "split", "row"], "left_anti")


def purged_kfold(df: DataFrame, k: int, embargo: str = "INTERVAL 24 HOURS", label: str | None = None, share: float | None = None) -> DataFrame:
    """k splits of df (time, t1): each fold is tested, and training rows that overlap its span or start in the embargo after
    it are purged. With a label the folds are stratified, and splits are left out whose test classes training lacks.
    The span runs from the first test time to the last test t1. share: the embargo is that share of a symbol's rows, after
    the last row tested, and not a time."""
    rows = stratified_folds(df, k, label) if label else folds(df, k)
    tests = rows.withColumn("split", F.col("fold"))
    spans = tests.groupBy("symbol", "split").agg(F.min("time").alias("start"), F.max(F.coalesce("t1", "time")).alias("end"))
    train = _purged(rows, tests, spans, embargo if share is None else "INTERVAL 0 HOURS")
    if share is not None:
        last = tests.groupBy("symbol", "split").agg(F.max("row").alias("_last")).join(_sizes(df), "symbol")
        after = F.col("row") - F.col("_last")
        train = train.join(last, ["symbol", "split"]).filter(~after.between(1, F.floor(F.col("n") * share))).select(*train.columns)
    out = train.unionByName(tests.select("symbol", "split", F.lit("test").alias("role"), "row"))
    if label:
        classes = out.join(rows.select("symbol", "row", label), ["symbol", "row"]).select("symbol", "split", "role", label).distinct()
        missing = classes.filter("role = 'test'").join(classes.filter("role = 'train'"), ["symbol", "split", label], "left_anti").select("symbol", "split").distinct()
        out = out.join(missing, ["symbol", "split"], "left_anti")
    return out


def purged_past(df: DataFrame, k: int) -> DataFrame:
    """k folds of df (time, t1), each tested after the rows of other folds whose t1 is not later than its first time."""
    rows = folds(df, k)
    tests = rows.select("symbol", F.col("fold").alias("split"), F.lit("test").alias("role"), "row")
    starts = rows.groupBy("symbol", "fold").agg(F.min("time").alias("_start")).withColumnRenamed("fold", "split")
    before = rows.join(starts, "symbol").filter((F.col("t1") <= F.col("_start")) & (F.col("fold") != F.col("split")))  # k rows a symbol
    return before.select("symbol", "split", F.lit("train").alias("role"), "row").unionByName(tests)


def combinatorial_purged(df: DataFrame, k: int, tested: int, embargo: str = "INTERVAL 24 HOURS") -> DataFrame:
    """One split for each choice of `tested` folds. Training rows are purged against one span over all of them, gaps
    included, and the embargo after it."""
    rows = folds(df, k)
    spark = df.sparkSession
    choices = [(i, f) for i, c in enumerate(combinations(range(k), tested)) for f in c]
    table = F.broadcast(spark.createDataFrame(choices, "split int, fold int"))
    tests = rows.join(table, "fold")
    spans = tests.groupBy("symbol", "split").agg(F.min("time").alias("start"), F.max("time").alias("end"))
    train = _purged(rows, tests, spans, embargo)
    return train.unionByName(tests.select("symbol", "split", F.lit("test").alias("role"), "row"))
