"""Forward-looking labels: barriers, trend scans, meta-labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.windows import PART, divide, fill_forward, in_chunks, order, pct_change, row_numbers, std
from tidemark.operators.align import as_of
from tidemark.operators.ranks import quantiles


def barrier_events(df: DataFrame, horizons: Sequence[int], vol_window: int = 288, base: float = 2.0, vol: Column | None = None) -> DataFrame:
    """Distances of target and stop (base times volatility: rolling deviation of returns, or a given column) and t1, the time
    of the longest horizon."""
    out = df.withColumn("_r", pct_change("close"))
    distance = base * (std(F.col("_r"), vol_window) if vol is None else vol)
    return out.withColumn("pt_dist", distance).withColumn("sl_dist", distance).withColumn("t1", F.lead("time", max(horizons)).over(order())).drop("_r")


def first_touch(df: DataFrame, horizons: Sequence[int], multiples: Sequence[float], spread: Column | float = 0.0, tie_long: str = "target", tie_short: str = "stop", part: Sequence[str] = PART) -> DataFrame:
    """long_hit_{m}R_h{h} and short_hit_{m}R_h{h}: 1 where the target is touched within h bars and the stop not before it.

    df needs pt_dist and sl_dist. A bar that touches both counts as the tie argument says: target or stop. Rows with fewer
    than h later bars are 0. A tree of block maxima (and minima) serves all levels and horizons: a row climbs it to the
    first block that reaches its level and descends to the bar, so no row carries its path and the time grows with the
    logarithm of the horizon. `part` names the series or, with windows.in_chunks, its chunks.
    """
    spread = F.lit(spread) if isinstance(spread, float) else spread
    most, close = max(horizons), F.col("close")
    levels = {"_stop_l": close - F.col("sl_dist"), "_stop_s": close + F.col("sl_dist")}
    for i, m in enumerate(multiples):
        reach = F.col("pt_dist") * m + spread
        levels |= {f"_target_l{i}": close + reach, f"_target_s{i}": close - reach}
    names = [f"{side}_hit_{m:g}R_h{h}" for m in multiples for h in horizons for side in ("long", "short")]
    given, searched = df.columns, list(levels)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}` byte" for c in names)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time", kind="stable")
        value = lambda c: rows[c].to_numpy(float)
        over, under = K.FirstOver(value("high")), K.FirstOver(-value("low"))
        after = {c: under.after(-value(c), most) if c == "_stop_l" or c.startswith("_target_s") else over.after(value(c), most) for c in searched}
        known = {side: ~np.isnan(value(f"_stop_{side}")) for side in "ls"}
        left = len(rows) - 1 - np.arange(len(rows))
        found = {}
        for i, m in enumerate(multiples):
            for side, tie in (("long", tie_long), ("short", tie_short)):
                target, stop = after[f"_target_{side[0]}{i}"], after[f"_stop_{side[0]}"]
                first = known[side[0]] & (target > 0) & ((stop == 0) | ((target <= stop) if tie == "target" else (target < stop)))
                for h in horizons:
                    found[f"{side}_hit_{m:g}R_h{h}"] = (first & (target <= h) & (left >= h)).astype(np.int8)
        return rows[given].assign(**found)

    return df.withColumns(levels).groupBy(*part).applyInPandas(run, schema)


def sample_weights(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.lit(1.0))


def trend_scan(df: DataFrame, window: int = 60, least: int = 5, step: int = 1, every: int = 12, epsilon: float = 1e-8, rows: int = 50_000) -> DataFrame:
    """For every `every`-th bar with `window` bars from it on: the length whose least-squares slope has the largest |t| (the
    shortest of equals), its end t1, t_value, ret over it and bin, the sign.

    Series are cut into chunks of `rows` bars, each with the bars that its last events still need; only events get the
    running sums of their window, and nothing but them leaves the chunk. A first close of 0 leaves ret unknown.
    """
    rows = max(rows, window)
    numbered = row_numbers(df.select("symbol", "time", F.col("close").cast("double").alias("close")))
    own, place = F.floor((F.col("rn") - 1) / rows), (F.col("rn") - 1) % rows
    also = F.array_compact(F.array(own, F.when((place < window - 1) & (own > 0), own - 1)))
    spread = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(also))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn")
        close, mine = part["close"].to_numpy(float), (part["_own"] == part["_chunk"]).to_numpy()
        at = np.flatnonzero(mine & ((part["rn"].to_numpy() - 1) % every == 0))
        at = at[at + window <= len(part)]
        lengths, t = K.trend_scans(close, at, window, least, step, epsilon) if len(at) else (at, np.zeros(0))
        at, lengths, t = at[~np.isnan(t)], lengths[~np.isnan(t)], t[~np.isnan(t)]
        end, first = at + lengths - 1, close[at]
        with np.errstate(all="ignore"):
            ret = np.where(first != 0, close[end] / first - 1, np.nan)
        return pd.DataFrame({"symbol": part["symbol"].to_numpy()[at], "time": part["time"].to_numpy()[at], "t1": part["time"].to_numpy()[end], "length": lengths, "t_value": t, "ret": ret, "bin": np.sign(t).astype(np.int32)})

    out = spread.groupBy("symbol", "_chunk").applyInPandas(run, "symbol string, time timestamp, t1 timestamp, length int, t_value double, ret double, bin int")
    return out.withColumn("ret", F.when(~F.isnan("ret"), F.col("ret")))


def strong_trends(scans: DataFrame, quantile: float = 0.8, ranges: int | None = None) -> DataFrame:
    """Events whose |t| is over the quantile of all, with side, the sign of t. ranges: the quantile by ranges of |t|
    (operators.ranks), for series that no task should hold; None where one task a series will do."""
    if ranges is None:
        level = scans.groupBy("symbol").agg(F.percentile(F.abs("t_value"), quantile).alias("_level"))
    else:
        level = quantiles(scans.select("symbol", F.abs("t_value").alias("_t")), "symbol", "_t", [quantile], ranges).select("symbol", F.col("_quantiles")[0].alias("_level"))
    return scans.join(level, "symbol").filter(F.abs("t_value") > F.col("_level")).withColumn("side", F.signum("t_value").cast("int")).drop("_level")


def vertical_barrier(df: DataFrame, bars: DataFrame, wait: str = "INTERVAL 5 DAYS", days: int | None = None) -> DataFrame:
    """vertical: the first bar at or after time + wait; null where the series ends before."""
    due = df.withColumn("_due", F.col("time") + F.expr(wait))
    times = bars.select("symbol", F.col("time").alias("_bar"), F.col("time").alias("vertical"))
    return as_of(due, times, ["vertical"], left_time="_due", right_time="_bar", forward=True, days=days).drop("_due")


def daily_change(df: DataFrame, over_zero: bool = False) -> DataFrame:
    """Return against the last bar at least a day earlier; over_zero as in operators.features."""
    past = df.select("symbol", F.col("time").alias("_past"), F.col("close").alias("_old"))
    rows = df.withColumn("_before", F.col("time") - F.expr("INTERVAL 1 DAY"))
    out = as_of(rows, past, ["_old"], left_time="_before", right_time="_past")
    return out.withColumn("day_ret", divide(F.col("close"), F.col("_old"), over_zero) - 1).drop("_old", "_before")


def barrier_labels(df: DataFrame, horizon: int, pt: float, sl: float, event: Column | None = None, rows: int = 100) -> DataFrame:
    """Labels of events (side, trgt) by the path of closes over the next `horizon` bars: the side-signed return first reaches
    pt times trgt (bin 1), falls to -sl times trgt (bin -1), or neither (bin 0, at the last bar). t1 and ret are those of
    the touch. `event` chooses the rows of df that are events (all if not given); the others are path only. Rows without
    a later bar are dropped. A close of 0 has no returns: its event is neither, with an unknown ret. Columns t1, ret and bin
    of df are replaced.

    Series are cut into chunks of `rows` bars (of the horizon, if that is more), and each event meets the bars of its chunk
    and of the horizon after it: no row carries its path, an event meets twice the bars it needs at most, and a long
    series is many tasks.
    """
    numbered = row_numbers(df)
    chunk, place, rows = F.floor((F.col("rn") - 1) / max(rows, horizon)), (F.col("rn") - 1) % max(rows, horizon), max(rows, horizon)
    chosen = numbered.filter(F.lit(True) if event is None else event).withColumn("_chunk", chunk)
    events = chosen.select("symbol", "_chunk", F.col("rn").alias("_from"), F.col("close").alias("_first"), "side", "trgt")
    also = F.array_compact(F.array(chunk, F.when((place < horizon) & (chunk > 0), chunk - 1)))
    path = numbered.select("symbol", F.explode(also).alias("_chunk"), F.col("rn").alias("_at"), F.col("time").alias("t1"), F.col("close").alias("_close"))
    met = events.join(path, ["symbol", "_chunk"]).filter((F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_from") + horizon))
    met = met.withColumn("ret", (F.try_divide("_close", "_first") - 1) * F.col("side"))
    met = met.withColumn("bin", F.when(F.col("ret") >= pt * F.col("trgt"), 1).when(F.col("ret") <= -sl * F.col("trgt"), -1).otherwise(0))
    end = F.struct("t1", "ret", "bin")
    first = F.min_by(end, F.when(F.col("bin") != 0, F.col("_at")))
    found = met.groupBy("symbol", "_chunk", F.col("_from").alias("rn")).agg(F.coalesce(first, F.max_by(end, "_at")).alias("_end"))
    return chosen.drop("t1", "ret", "bin").join(found, ["symbol", "_chunk", "rn"]).select(*(c for c in df.columns if c not in ("t1", "ret", "bin")), "_end.*")


def barrier_labels_by_time(df: DataFrame, pt: float, sl: float, end: str = "vertical", event: Column | None = None, days: int = 1) -> DataFrame:
    """barrier_labels whose paths end at a time of their own, the column `end` (included), however many bars that is. Where
    end is null, the path goes on to the last bar, and only events that it touches are returned.

    An interval join: events meet the bars of the spans of `days` days that their path reaches into, so that a series is
    many tasks and no row carries its path.
    """
    span = lambda at: F.floor(F.unix_seconds(at) / (86400 * days))
    chosen = df.filter(F.lit(True) if event is None else event)
    last = df.groupBy("symbol").agg(F.max("time").alias("_last"))
    events = chosen.join(last, "symbol").select("symbol", F.col("time").alias("_from"), F.col(end).alias("_end"), F.coalesce(end, "_last").alias("_until"), F.col("close").alias("_first"), "side", "trgt")
    events = events.withColumn("_span", F.explode(F.sequence(span(F.col("_from")), span(F.col("_until")))))
    path = df.select("symbol", span(F.col("time")).alias("_span"), F.col("time").alias("t1"), F.col("close").alias("_close"))
    met = events.join(path, ["symbol", "_span"]).filter((F.col("t1") > F.col("_from")) & (F.col("t1") <= F.col("_until")))
    met = met.withColumn("ret", (F.try_divide("_close", "_first") - 1) * F.col("side"))
    met = met.withColumn("bin", F.when(F.col("ret") >= pt * F.col("trgt"), 1).when(F.col("ret") <= -sl * F.col("trgt"), -1).otherwise(0))
    found = F.struct("t1", "ret", "bin")
    first, final = F.min_by(found, F.when(F.col("bin") != 0, F.col("t1"))), F.max_by(found, F.when(F.col("_end").isNotNull(), F.col("t1")))
    ends = met.groupBy("symbol", F.col("_from").alias("time")).agg(F.coalesce(first, final).alias("_found")).filter("_found IS NOT NULL")
    return chosen.drop("t1", "ret", "bin").join(ends, ["symbol", "time"]).select(*(c for c in df.columns if c not in ("t1", "ret", "bin")), "_found.*")


def short_recode(df: DataFrame) -> DataFrame:
    """Three classes for short events by the sign of ret: -1 for gains, 1 for losses."""
    return df.withColumn("bin", F.when(F.col("side") < 0, -F.signum("ret").cast("int")).otherwise(F.col("bin")))


def dynamic_labels(df: DataFrame, horizons: Sequence[int], ratios: Sequence[float], atr: str = "atr", scale: float = 2.0, pips: float = 2.0, pip: float = 0.0001, rows: int = 100_000) -> DataFrame:
    """first_touch with stops of `scale` times the column `atr`, targets at ratios of the stop plus `pips` of size `pip`, and
    targets looked at first on both sides; rows without atr are dropped first. t1: the time of the longest horizon, and at the end of a
    series the last one known."""
    distance = scale * F.col(atr)
    out = df.filter(F.col(atr).isNotNull()).withColumn("pt_dist", distance).withColumn("sl_dist", distance)
    cost = F.lit(pips * pip)
    most = max(horizons)
    touched = in_chunks(out, lambda x, part: first_touch(x, horizons, ratios, cost, "target", "target", part), ahead=most, rows=max(rows, 2 * most)).drop("pt_dist", "sl_dist")
    t1 = touched.withColumn("_t1", F.lead("time", most).over(order()))
    return t1.withColumn("t1", fill_forward(F.col("_t1"))).drop("_t1")


def plain(multiple: float) -> str:
    """A multiple as part of a column's name: 1_5 for 1.5."""
    return f"{multiple:g}".replace(".", "_")


def barrier_hits(df: DataFrame, horizon: int, multiples: Sequence[float], stop: float, sides: Sequence[int] = (1, -1), wait: str | None = None) -> DataFrame:
    """df (trgt) with long_hit_rr{m} and short_hit_rr{m} (m as 1_5 for 1.5): 1 where barrier_labels of a trade on that side wins; t1 is that of the
    last multiple's long trade. Rows without a later bar or trgt are 0. wait: trades last for that interval, to the first bar
    at or after it, and not for `horizon` bars."""
    df = df if wait is None else vertical_barrier(df, df, wait)
    out = df
    for m in multiples:
        for side in sides:
            name = f"{'long' if side > 0 else 'short'}_hit_rr{plain(m)}"
            found = _barriers(df.withColumn("side", F.lit(side)), horizon, m, stop, F.col("trgt").isNotNull(), wait)
            ends = [F.col("t1")] if (m, side) == (multiples[-1], sides[0]) else []
            found = found.select("symbol", "time", (F.col("bin") == 1).cast("int").alias(name), *ends)
            out = out.join(found, ["symbol", "time"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out if wait is None else out.drop("vertical")


def _barriers(df: DataFrame, horizon: int, pt: float, sl: float, event: Column, wait: str | None) -> DataFrame:
    return barrier_labels(df, horizon, pt, sl, event) if wait is None else barrier_labels_by_time(df, pt, sl, "vertical", event)


def trend_meta_labels(df: DataFrame, horizon: int, multiples: Sequence[float], stop: float, window: int = 20, limit: float = 2.0, wait: str | None = None) -> DataFrame:
    """df (trgt) with side, the sign of trends whose |t| is over the limit (else null), and meta_rr{m}: 1 where barrier_labels
    of that side wins, else 0. wait: trades last for that interval, as in barrier_hits, and its end is the column t1."""
    df = df if wait is None else vertical_barrier(df, df, wait)
    sides = trend_scan(df, window, every=1).filter(F.abs("t_value") > limit).select("symbol", "time", F.signum("t_value").cast("int").alias("side"))
    out = df.join(sides, ["symbol", "time"], "left")
    marked = out
    for m in multiples:
        found = _barriers(marked, horizon, m, stop, F.col("side").isNotNull() & F.col("trgt").isNotNull(), wait)
        name = f"meta_rr{plain(m)}"
        found = found.select("symbol", "time", (F.col("bin") == 1).cast("int").alias(name))
        out = out.join(found, ["symbol", "time"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out if wait is None else out.withColumnRenamed("vertical", "t1")


def meta_features(df: DataFrame, probabilities: Sequence[str], more: Sequence[str] = (), key: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """The features of a second model: agreement and confidence of the first models' probabilities and further columns of df,
    0 where unknown."""
    out = confidence(agreement(df, probabilities), probabilities)
    names = ["p_mean", "p_max", "p_min", "p_var", "p_std", "top1", "top2", "spread", "entropy", *more]
    return out.select(*key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names))


def binary_meta_label(prediction: Column, label: Column) -> Column:
    return F.coalesce((prediction == 1) & (label > 0), F.lit(False)).cast("int")


def agreement(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """p_mean, p_max, p_min, p_var and p_std (sample) over columns of each row."""
    n = len(columns)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    out = df.withColumn("p_mean", total / n).withColumn("p_max", F.greatest(*columns)).withColumn("p_min", F.least(*columns))
    spread = sum((F.pow(F.col(c) - F.col("p_mean"), 2) for c in columns[1:]), F.pow(F.col(columns[0]) - F.col("p_mean"), 2))
    return out.withColumn("p_var", spread / (n - 1)).withColumn("p_std", F.sqrt("p_var"))


def confidence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The two highest probabilities of each row, their distance, and the entropy of the normalised ones over its most."""
    ranked = F.sort_array(F.array(*columns), asc=False)
    out = df.withColumn("top1", ranked[0]).withColumn("top2", ranked[1]).withColumn("spread", F.col("top1") - F.col("top2"))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) + 1e-12
    entropy = F.aggregate(F.transform(F.array(*columns), lambda p: p / total), F.lit(0.0), lambda a, p: a - p * F.ln(p + 1e-12))
    return out.withColumn("entropy", entropy / F.ln(F.lit(float(len(columns)))))


def meta_rules(df: DataFrame) -> DataFrame:
    """Trade quality, size, entry timing and risk class from top1, spread and volatility_regime."""
    top, gap = F.col("top1"), F.col("spread")
    quality = F.when((top >= 0.80) & (gap >= 0.25), 3).when((top >= 0.65) & (gap >= 0.15), 2).when(top >= 0.55, 1).otherwise(0)
    out = df.withColumn("trade_quality", quality)
    out = out.withColumn("position_size", F.element_at(F.array(*map(F.lit, (0.0, 1.0, 1.5, 2.5))), F.col("trade_quality") + 1))
    out = out.withColumn("entry_timing", F.when(gap >= 0.25, 2).when(gap < 0.10, 0).otherwise(1))
    return out.withColumn("risk", F.greatest(F.lit(0), F.least(F.lit(2), F.col("volatility_regime"))))


def sequence_windows(df: DataFrame, features: Sequence[str], length: int, batch: int) -> DataFrame:
    """Windows of `length` rows of features up to each row that has so many, with the number of its batch."""
    frame = order().rowsBetween(1 - length, 0)
    out = df.withColumn("sequence", F.collect_list(F.array(*(F.col(c).cast("double") for c in features))).over(frame)).filter(F.size("sequence") == length)
    return out.withColumn("batch", F.floor((F.row_number().over(order()) - 1) / batch))
