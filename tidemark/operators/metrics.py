"""Backtest and classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.windows import order, running_product


def _ratio(top: Column, bottom: Column, at_zero: Column) -> Column:
    return F.when(bottom == 0, at_zero).otherwise(F.try_divide(top, bottom))


def equity_metrics(equity: DataFrame, value: str = "equity", periods: int = 252, rate: float = 0.0) -> DataFrame:
    """Per series: total return, Sharpe, Sortino and Calmar ratios and maximum drawdown (zero or below) of an equity curve."""
    w = order()
    top = F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = equity.withColumn("_r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1).withColumn("_d", F.try_divide(F.col(value) - top, top))
    excess = F.col("_r") - rate / periods
    infinite = F.lit(float("inf"))
    stats = rows.groupBy("symbol").agg(F.min_by(value, "time").alias("first"), F.max_by(value, "time").alias("last"), F.avg(excess).alias("m"), F.stddev_samp(excess).alias("s"), F.stddev_samp(F.when(excess < 0, excess)).alias("down"), F.avg("_r").alias("r"), F.min("_d").alias("max_drawdown"))
    root = F.lit(periods**0.5)
    return stats.select("symbol", (F.try_divide("last", "first") - 1).alias("total_return"), (root * F.try_divide("m", F.nullif(F.col("s"), F.lit(0.0)))).alias("sharpe"), (root * _ratio(F.col("m"), F.col("down"), infinite / root)).alias("sortino"), "max_drawdown", _ratio(F.col("r") * periods, F.abs("max_drawdown"), infinite).alias("calmar"))


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Per series of trades (symbol, pnl): number, hit rate, mean profit and profit factor (infinite without losses)."""
    gain, loss = F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0)))
    stats = trades.groupBy("symbol").agg(F.count("pnl").alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("hit_rate"), F.avg("pnl").alias("avg_profit"), gain.alias("gain"), loss.alias("loss"))
    return stats.withColumn("profit_factor", F.when(F.col("trades") == 0, 0.0).otherwise(_ratio(F.col("gain"), F.col("loss"), F.lit(float("inf"))))).drop("gain", "loss")


def signal_backtest(df: DataFrame, periods: int = 252 * 288) -> DataFrame:
    """df (side, ret): position is the signal of the bar before; strategy returns and the equity they compound to, which losses
    of more than all turn negative."""
    out = df.withColumn("position", F.coalesce(F.lag("side").over(order()), F.lit(0))).withColumn("strategy_ret", F.col("position") * F.coalesce("ret", F.lit(0.0)))
    return out.withColumn("equity", running_product(1 + F.col("strategy_ret")))


def objective(metrics: DataFrame, legacy: bool = False) -> DataFrame:
    """Weighted score of sharpe, avg_return, stability (minus the deviation of trade returns), max_drawdown and hit_rate; -10
    with fewer than 20 trades, and lower still over 8 % drawdown. legacy: the drawdown keeps its sign, so that rule never
    fires."""
    fall = F.col("max_drawdown") if legacy else F.abs("max_drawdown")
    score = 0.35 * F.col("sharpe") + 0.25 * 100 * F.col("avg_return") + 0.20 * F.col("stability") + 0.15 * (1 - fall) + 0.05 * F.col("hit_rate")
    return metrics.withColumn("score", F.when(F.col("trades") < 20, -10.0).when(fall > 0.08, -10 - 100 * fall).otherwise(F.coalesce(score, F.lit(-10.0))))


def sharpe_score(df: DataFrame, by: str, value: str, periods: int = 252) -> DataFrame:
    """Annualised mean over population deviation, 0 where there is none, clipped score and downside ratio per group."""
    stats = df.groupBy(by).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.stddev_pop(F.when(F.col(value) < 0, F.col(value))).alias("d"), F.avg((F.col(value) > 0).cast("double")).alias("hit_ratio"))
    root = F.lit(periods**0.5)
    ratio = lambda b: F.coalesce(root * F.try_divide("m", F.nullif(F.col(b), F.lit(0.0))), F.lit(0.0))
    out = stats.withColumn("sharpe", ratio("s")).withColumn("sortino", ratio("d"))
    return out.withColumn("sharpe_clipped", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sharpe") + 1) / 4))).withColumn("sharpe_squashed", (F.tanh(F.col("sharpe") / 2) + 1) / 2).drop("m", "s", "d")


def threshold_search(df: DataFrame, by: str, proba: str, ret: str | None = None, side: str | None = None, label: str | None = None, metric: str = "f1", periods: int = 252 * 288, start: float = 0.05, stop: float = 0.90, step: float = 0.05) -> DataFrame:
    """The smallest threshold with the best score of the rows whose probability is over it: its score and how many rows those are.

    metric f1 compares them with the 0/1 column `label`. sharpe and sortino take `ret` times `side` (1 if not given) of
    these rows, and 0 of all others: the mean of all rows over the population deviation of all, or of the losses, times
    the root of periods; 0 where there is none. Rows are added up by how many thresholds they are over, and the sums of
    those cells from the top down give every threshold's score, so no row is expanded.
    """
    n = round((stop - start) / step) + 1
    levels = [round(start + i * step, 10) for i in range(n)]
    x = F.lit(0.0) if ret is None else F.coalesce(F.col(ret) * (F.lit(1) if side is None else F.col(side)), F.lit(0.0)).cast("double")
    hit = F.lit(0) if label is None else F.coalesce((F.col(label) == 1).cast("int"), F.lit(0))
    rows = df.select(by, F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: t < F.col(proba))).alias("cell"), x.alias("x"), hit.alias("hit"))
    loss = F.when(F.col("x") < 0, F.col("x"))
    zero = F.lit(0.0)
    sums = {"n": F.count(F.lit(1)).cast("double"), "hits": F.sum("hit").cast("double"), "x1": F.sum("x"), "x2": F.sum(F.col("x") * F.col("x")), "d0": F.count(loss).cast("double"), "d1": F.coalesce(F.sum(loss), zero), "d2": F.coalesce(F.sum(loss * loss), zero)}
    cells = rows.groupBy(by, "cell").agg(*(v.alias(k) for k, v in sums.items()))
    whole = cells.groupBy(by).agg(F.collect_list(F.struct("cell", *sums)).alias("cells"), F.sum("n").alias("all"), F.sum("hits").alias("true"))  # at most n + 1 cells
    tried = whole.select(by, "cells", "all", "true", F.posexplode(F.array(*map(F.lit, levels))).alias("i", "threshold"))
    above = lambda k: F.aggregate(F.filter("cells", lambda c: c["cell"] > F.col("i")), F.lit(0.0), lambda a, c: a + c[k])
    tried = tried.select(by, "all", "true", "threshold", *(above(k).alias(k) for k in sums))

    def deviation(count: Column, first: Column, second: Column) -> Column:
        spread = F.try_divide(second, count) - F.pow(F.try_divide(first, count), 2)
        return F.when(spread > 1e-14 * F.try_divide(second, count), F.sqrt(spread))

    mean = F.col("x1") / F.col("all")
    root = F.lit(periods**0.5)
    scores = {
        "f1": F.try_divide(2 * F.col("hits"), F.nullif(F.col("n") + F.col("true"), zero)),
        "sharpe": root * mean / deviation(F.col("all"), F.col("x1"), F.col("x2")),
        "sortino": root * mean / deviation(F.col("d0"), F.col("d1"), F.col("d2")),
    }
    scored = tried.withColumn("score", F.coalesce(scores[metric], zero))
    best = scored.groupBy(by).agg(F.max_by(F.struct("threshold", "score", F.col("n").cast("long").alias("n")), F.struct(F.round("score", 9).alias("s"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(by, "b.threshold", "b.score", "b.n")


def binary_scores(df: DataFrame, by: str, truth: str, guess: str) -> DataFrame:
    """Accuracy, precision, recall and F1 per group of 0/1 guesses, where any label but 0 is a hit; 0 where there is none."""
    t, g = F.col(truth) != 0, F.col(guess) == 1
    stats = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((t == g).cast("double")).alias("accuracy"), F.count_if(t & g).alias("tp"), F.count_if(g).alias("claimed"), F.count_if(t).alias("real"))
    share = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))
    return stats.select(by, "n", "accuracy", share(F.col("tp"), F.col("claimed")).alias("precision"), share(F.col("tp"), F.col("real")).alias("recall"), share(2 * F.col("tp"), F.col("claimed") + F.col("real")).alias("f1_score"))


def classification(df: DataFrame, by: str, truth: str, guess: str) -> DataFrame:
    """Accuracy and weighted precision, recall and F1 per group, from its confusion counts."""
    cells = df.groupBy(by, truth, guess).agg(F.count(F.lit(1)).alias("n"))
    right = cells.filter(F.col(truth) == F.col(guess)).select(by, F.col(truth).alias("c"), F.col("n").alias("tp"))
    real = cells.groupBy(by, F.col(truth).alias("c")).agg(F.sum("n").alias("support"))
    named = cells.groupBy(by, F.col(guess).alias("c")).agg(F.sum("n").alias("claimed"))
    per = real.join(right, [by, "c"], "left").join(named, [by, "c"], "left").na.fill(0, ["tp", "claimed"])
    per = per.withColumn("p", F.coalesce(F.try_divide("tp", "claimed"), F.lit(0.0))).withColumn("r", F.try_divide("tp", "support"))
    per = per.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.nullif(F.col("p") + F.col("r"), F.lit(0.0))), F.lit(0.0)))
    total = F.sum("support")
    return per.groupBy(by).agg(total.alias("n"), (F.sum("tp") / total).alias("accuracy"), *((F.sum(F.col(k) * F.col("support")) / total).alias(v) for k, v in (("p", "precision"), ("r", "recall"), ("f", "f1_weighted"))))


def ensemble_vote(df: DataFrame, key: list[str], probabilities: list[str]) -> DataFrame:
    """Mean of each class's probability over models, and the class (from 0) with the highest (the first of equals)."""
    out = df.groupBy(*key).agg(*(F.avg(c).alias(c) for c in probabilities))
    return out.withColumn("vote", (F.array_position(F.array(*probabilities), F.greatest(*probabilities)) - 1).cast("int"))


def evaluate_predictions(df: DataFrame, by: str, truth: str, guess: str, ret: str | None = None, periods: int = 252, squash: bool = False) -> DataFrame:
    """Per group of classes -1, 0, 1: accuracy, f1_weighted, sharpe, sortino, hit_ratio of the guessed positions, and combined.

    Returns are those of the column `ret` (unknown ones 0), or a thousandth in the direction of the truth. Ratios are mean
    over population deviation times the root of periods, 0 where there is none; the downside needs two losses. hit_ratio
    is null without trades. combined: with a proxy 0.3 accuracy and 0.7 of the clipped (sharpe + 1) / 4; with `ret` 0.2
    accuracy and 0.8 of the clipped (sharpe + 2) / 5, or, squashed, of (tanh(sharpe / 2) + 1) / 2.
    """
    market = 0.001 * F.col(truth) if ret is None else F.col(ret)
    rows = df.withColumn("_x", F.coalesce(F.col(guess) * market, F.lit(0.0)))
    down = F.when(F.col("_x") < 0, F.col("_x"))
    stats = rows.groupBy(by).agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"), F.when(F.count(down) > 1, F.stddev_pop(down)).alias("d"), F.try_divide(F.count_if(F.col("_x") > 0), F.count_if(F.col("_x") != 0)).alias("hit_ratio"))
    root = F.lit(periods**0.5)
    ratio = lambda b: F.coalesce(root * F.try_divide("m", F.nullif(F.col(b), F.lit(0.0))), F.lit(0.0))
    out = classification(df, by, truth, guess).join(stats.select(by, ratio("s").alias("sharpe"), ratio("d").alias("sortino"), "hit_ratio"), by)
    clipped = lambda offset, scale: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sharpe") + offset) / scale))
    if ret is None:
        score = 0.3 * F.col("accuracy") + 0.7 * clipped(1, 4)
    else:
        score = 0.2 * F.col("accuracy") + 0.8 * ((F.tanh(F.col("sharpe") / 2) + 1) / 2 if squash else clipped(2, 5))
    return out.withColumn("combined", score)


def log_loss(df: DataFrame, by: str, label: str, probability: str, least: float = 1e-15) -> DataFrame:
    """Mean of -ln of the probability given to the class that came true, for 0/1 labels and the probability of 1."""
    p = F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col(probability)))
    return df.groupBy(by).agg((-F.avg(F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p)))).alias("log_loss"))


def fold_info(splits: DataFrame, labels: DataFrame, label: str, key: Sequence[str] = ("symbol", "row")) -> DataFrame:
    """Rows and share of each class by split and role."""
    counts = splits.join(labels.select(*key, label), list(key)).groupBy("split", "role", label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("split", "role")))


def mean_absolute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean size of each column (contributions of features, say) over all rows, the largest first."""
    rows = df.select(*(F.abs(F.col(c).cast("double")).alias(c) for c in columns)).unpivot([], list(columns), "feature", "value")
    return rows.groupBy("feature").agg(F.avg("value").alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")


def with_attributes(trials: DataFrame, attributes: DataFrame, on: str = "trial") -> DataFrame:
    """Trials with what else is known of them; those without attributes stay."""
    return trials.join(attributes, on, "left")
