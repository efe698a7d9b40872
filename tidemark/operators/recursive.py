"""Operators whose state runs along a series: exponential means, oscillators, cumulative-sum events, sliding kernels.

Exponential means are linear recurrences, which compose: chunks of a series are summed up side by side, and each gets
what the chunks before it carry over. Sliding kernels only need the last rows, so they run on chunks with a halo.
Cumulative-sum events start anew where they fire, so chunks first run as if nothing came before them; where the chunk
before left something, they run again from that, until every chunk starts from what the one before it leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions.windows import PART, fill_forward, flag, in_chunks, lag, last_rows, mean, order, pct_change, row_numbers, std
from tidemark.operators.align import as_of
from tidemark.sources.shared import work_folder


def along(df: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]], kind: str = "double", part: Sequence[str] = PART) -> DataFrame:
    """Adds columns computed from each whole series in the order of time."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}` {kind}" for c in columns)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time", kind="stable")
        return rows.assign(**{c: f(rows) for c, f in columns.items()})

    out = df.groupBy(*part).applyInPandas(run, schema)
    return unknown_to_null(out, columns) if kind == "double" else out


def unknown_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in columns})


#: Rows of a series that one task sums up, and that one task looks for events in.
ROWS, EVENT_ROWS = 500_000, 100_000


def chunk_rows(df: DataFrame, rows: int = ROWS) -> int | None:
    """rows where a series of df is longer than that; None where one task a series will do. Counts the rows of each."""
    longest = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return rows if (longest or 0) > rows else None


def recurrences(df: DataFrame, columns: dict[str, tuple[Column, float]], rows: int | None = ROWS) -> DataFrame:
    """Adds columns s with s[t] = keep * s[t - 1] + input[t] along each series, from (input, keep); unknown inputs count as 0.

    Chunks of `rows` rows are summed up first; what those before a chunk add up to, one row a chunk, is where it starts
    from, so that a series of any length is many tasks. The rows are read twice for that, so with long plans before it,
    where series are short, rows=None takes each series as one chunk.
    """
    if rows is None:
        inputs = {f"_in{i}": F.coalesce(x.cast("double"), F.lit(0.0)) for i, (x, _) in enumerate(columns.values())}
        whole = {c: (lambda r, i=i, k=k: K.recurrence(r[f"_in{i}"].to_numpy(), k)) for i, (c, (_, k)) in enumerate(columns.items())}
        return along(df.withColumns(inputs), whole).drop(*inputs)
    given, names = "rn" in df.columns, list(columns)
    inputs = {f"_in{i}": F.coalesce(x.cast("double"), F.lit(0.0)) for i, (x, _) in enumerate(columns.values())}
    keep, read = [k for _, k in columns.values()], list(inputs)
    numbered = row_numbers(df.withColumns(inputs)).withColumn("_chunk", F.floor((F.col("rn") - 1) / rows))
    left = (F.col("_chunk") + 1) * rows - F.col("rn")  # rows of a whole chunk after this one
    ends = numbered.groupBy("symbol", "_chunk").agg(*(F.sum(F.col(x) * F.pow(F.lit(k), left)).alias(f"_end{i}") for i, (x, k) in enumerate(zip(read, keep, strict=True))))
    before = F.collect_list(F.struct(*(f"_end{i}" for i in range(len(names))))).over(W.partitionBy("symbol").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    carry = lambda i, k: F.aggregate("_before", F.lit(0.0), lambda total, e: total * F.lit(k**rows) + e[f"_end{i}"])
    carried = ends.withColumn("_before", before).select("symbol", "_chunk", *(carry(i, k).alias(f"_carry{i}") for i, k in enumerate(keep)))
    given_columns = [*df.columns, *([] if given else ["rn"])]
    kinds = dict(numbered.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in given_columns), *(f"`{c}` double" for c in names)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, found = part.sort_values("rn"), {}
        for i, (c, x, k) in enumerate(zip(names, read, keep, strict=True)):
            values = part[x].to_numpy(copy=True)
            values[0] += k * part[f"_carry{i}"].iloc[0]
            found[c] = K.recurrence(values, k)
        return part[given_columns].assign(**found)

    out = numbered.join(carried, ["symbol", "_chunk"]).groupBy("symbol", "_chunk").applyInPandas(run, schema)
    return out if given else out.drop("rn")


def weighted(df: DataFrame, columns: dict[str, Column], n: int, rows: int | None = ROWS) -> DataFrame:
    """Adds exponential means with alpha 1 / n over all values so far (weights add up to 1), null before n values."""
    keep = 1 - 1 / n
    parts = {}
    for c, x in columns.items():
        known = x.isNotNull().cast("double")
        parts |= {f"_{c}_sum": (x, keep), f"_{c}_weight": (known, keep), f"_{c}_count": (known, 1.0)}
    out = recurrences(df, parts, rows)
    means = {c: F.when(F.col(f"_{c}_count") > n - 0.5, F.try_divide(f"_{c}_sum", f"_{c}_weight")) for c in columns}
    return out.withColumns(means).drop(*parts)


def emas(df: DataFrame, lengths: Sequence[int] = (20, 50, 200), value: str = "close", prefix: str = "ema_", suffix: str = "", rows: int | None = ROWS) -> DataFrame:
    """Exponential means with alpha 2 / (n + 1), started by the plain mean of the first n values; null before."""
    given = "rn" in df.columns
    out = row_numbers(df) if given or rows is not None else df.withColumn("rn", F.row_number().over(order()))
    parts = {}
    for n in lengths:
        alpha = 2 / (n + 1)
        first = F.avg(value).over(last_rows(n))
        parts[f"{prefix}{n}{suffix}"] = (F.when(F.col("rn") == n, first).when(F.col("rn") > n, alpha * F.col(value)), 1 - alpha)
    out = recurrences(out, parts, rows)
    return out.withColumns({c: F.when(F.col("rn") >= n, F.col(c)) for c, n in zip(parts, lengths, strict=True)}).drop(*([] if given else ["rn"]))


def ordered_sign(a: Column, b: Column, c: Column | None = None) -> Column:
    """1 where a > b (> c), -1 where a < b (< c), 0 otherwise or unknown."""
    up, down = a > b, a < b
    if c is not None:
        up, down = up & (b > c), down & (b < c)
    return flag(up) - flag(down)


def trend(df: DataFrame, rows: int | None = ROWS) -> DataFrame:
    """EMAs, their alignment and the acceleration of the fast one."""
    out = emas(df, rows=rows)
    out = out.withColumn("ema_algnment", ordered_sign(F.col("ema_20"), F.col("ema_50"), F.col("ema_200")))
    out = out.withColumn("_s", F.col("ema_20") - lag("ema_20")).withColumn("_a", F.col("_s") - lag("_s"))
    return out.withColumn("ema_slope_acceleration", mean(F.col("_a"), 10)).drop("_s", "_a")


def higher_trend(df: DataFrame, legacy: bool = False, rows: int | None = ROWS) -> DataFrame:
    """EMAs of hourly and four-hourly closes at each bar. A bucket counts once it is over (legacy: from its start, which
    looks ahead). Empty buckets are left out."""
    out = df
    for width, hours, lengths in (("1 hour", 1, (20, 50, 200)), ("4 hours", 4, (20, 50))):
        tag = f"_h{hours}"
        buckets = df.groupBy("symbol", F.window("time", width).alias("w")).agg(F.max_by("close", "time").alias("close"))
        known = F.col("w.start") if legacy else F.col("w.end")
        slow = emas(buckets.select("symbol", known.alias("time"), "close"), lengths, prefix="ema", suffix=tag, rows=rows).drop("close")
        out = as_of(out, slow, [f"ema{n}{tag}" for n in lengths])
    out = out.withColumn("ema_alignment_h1", ordered_sign(F.col("ema20_h1"), F.col("ema50_h1"), F.col("ema200_h1")))
    return out.withColumn("ema_alignment_h4", ordered_sign(F.col("ema20_h4"), F.col("ema50_h4")))


def true_range(first: Column | None = None) -> Column:
    """The largest of high - low and the distances of both to the close before; `first` (unknown if not given) at the first
    bar."""
    before = lag("close")
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))).otherwise(F.lit(None).cast("double") if first is None else first)


def oscillators(df: DataFrame, rows: int | None = ROWS) -> DataFrame:
    """ATR and its expansion, RSI and its momentum regime, ADX (under two names)."""
    n, given = 14, "rn" in df.columns
    out = row_numbers(df).withColumn("_tr", true_range()).withColumn("_c", F.col("close") - lag("close"))
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    out = out.withColumn("_p", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_m", F.when((down > up) & (down > 0), down).otherwise(0.0))
    zero = F.lit(0.0)
    ups, downs = F.when(F.col("_c").isNotNull(), F.greatest("_c", zero)), F.when(F.col("_c").isNotNull(), F.least("_c", zero))
    out = weighted(out, {"atr_14": F.col("_tr"), "_up": ups, "_down": downs, "_plus": F.col("_p"), "_minus": F.col("_m")}, n, rows)
    out = out.withColumn("rsi_14", F.try_divide(100 * F.col("_up"), F.nullif(F.col("_up") + F.abs("_down"), zero)))
    way = F.try_divide(100 * F.abs(F.col("_plus") - F.col("_minus")), F.nullif(F.col("_plus") + F.col("_minus"), zero))
    out = weighted(out.withColumn("_dx", F.when(F.col("atr_14") > 0, way)), {"adx_14": F.col("_dx")}, n, rows)
    out = out.drop("_tr", "_c", "_p", "_m", "_up", "_down", "_plus", "_minus", "_dx", *([] if given else ["rn"]))
    out = out.withColumn("_a", F.col("atr_14") - lag("atr_14")).withColumn("_r", F.col("rsi_14") - lag("rsi_14"))
    out = out.withColumn("vol_expansion_rate", mean(F.col("_a"), 10)).withColumn("_m", mean(F.col("_r"), 10))
    regime = F.when(F.col("_m") > 0.5, 1).when(F.col("_m") < -0.5, -1).otherwise(0)
    return out.withColumn("momentum_regime", regime).withColumn("trend_strength_index", F.col("adx_14")).drop("_a", "_r", "_m")


def target_volatility(df: DataFrame, n: int = 100) -> DataFrame:
    """Exponential mean of the true range with alpha 1 / n from the first bar on."""
    given, out = "rn" in df.columns, row_numbers(df)
    out = out.withColumn("_t", true_range(F.col("high") - F.col("low")))
    part = F.when(F.col("rn") == 1, F.col("_t")).otherwise(F.col("_t") / n)
    return recurrences(out.withColumn("_t", part), {"target_vol": (F.col("_t"), 1 - 1 / n)}).drop("_t", *([] if given else ["rn"]))


def average_true_range(df: DataFrame, n: int = 100, name: str = "atr") -> DataFrame:
    """Exponential mean of the true range with alpha 1 / n, null before n ranges."""
    return weighted(df.withColumn("_tr", true_range()), {name: F.col("_tr")}, n).drop("_tr")


def daily_volatility(df: DataFrame, span: int = 100) -> DataFrame:
    """Exponential deviation (bias-corrected) of day_ret, carried forward, then backward to the start."""
    keep = 1 - 2 / (span + 1)
    x, known = F.coalesce("day_ret", F.lit(0.0)), F.col("day_ret").isNotNull().cast("double")
    out = recurrences(df, {"_s": (x, keep), "_q": (x * x, keep), "_w": (known, keep), "_w2": (known, keep * keep)})
    mean = F.try_divide("_s", F.nullif(F.col("_w"), F.lit(0.0)))
    spread = F.greatest(F.try_divide("_q", F.nullif(F.col("_w"), F.lit(0.0))) - mean * mean, F.lit(0.0))
    more = F.col("_w") * F.col("_w") - F.col("_w2")  # 0 for a single value, but for rounding
    vol = F.when(more > 1e-9 * F.col("_w2"), F.sqrt(spread * F.try_divide(F.col("_w") * F.col("_w"), more)))
    out = out.withColumn("_v", vol).withColumn("daily_vol", fill_forward(F.col("_v")))
    first = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("time"))).over(W.partitionBy("symbol"))
    return out.withColumn("daily_vol", F.coalesce("daily_vol", first)).drop("_s", "_q", "_w", "_w2", "_v")


def with_events(df: DataFrame, name: str, kernel: Callable[..., tuple[np.ndarray, float, float]], inputs: Sequence[str], rows: int | None = None) -> DataFrame:
    """Adds name, the events that kernel(*inputs, up, down) finds along each series; it takes the two sums that earlier rows
    left and gives those that it leaves.

    rows=None takes each series as one task. Else it is cut into chunks of so many rows. All run from sums of 0 first;
    then those whose predecessor leaves other sums than they started from run again, until none does. Two paths meet
    where both start anew, so a chunk mostly leaves the same sums wherever it starts from and the second round is the
    last; the rounds are at most the chunks of a series, and the result is that of one pass in any case. Values and
    sums are written to the shared folder, so a round does not depend on the rounds before it.
    """
    if rows is None:
        return along(df, {name: lambda r: kernel(*(r[c].to_numpy(float) for c in inputs))[0]}, "byte")
    spark, given = df.sparkSession, df.columns
    folder = work_folder(spark, name)
    numbered = row_numbers(df).withColumn("_chunk", F.floor((F.col("rn") - 1) / rows))
    packed = F.sort_array(F.collect_list(F.struct("rn", *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in inputs))))
    values = numbered.groupBy("symbol", "_chunk").agg(packed.alias("_v"))
    values.select("symbol", "_chunk", *(F.col(f"_v.{c}").alias(c) for c in inputs)).write.parquet(f"{folder}/values")
    values = spark.read.parquet(f"{folder}/values")

    def sums(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in parts:
            left = [kernel(*(np.asarray(r[c], float) for c in inputs), r["up"], r["down"])[1:] for r in part.to_dict("records")]
            yield part[["symbol", "_chunk", "up", "down"]].assign(up_left=[x for x, _ in left], down_left=[x for _, x in left])

    def kept(states: DataFrame, turn: int) -> DataFrame:
        states.write.parquet(f"{folder}/sums-{turn}")
        return spark.read.parquet(f"{folder}/sums-{turn}")

    kinds = ", ".join(f"`{c}` {t}" for c, t in values.select("symbol", "_chunk").dtypes) + ", up double, down double, up_left double, down_left double"
    states, turn = kept(values.withColumn("up", F.lit(0.0)).withColumn("down", F.lit(0.0)).mapInPandas(sums, kinds), 0), 0
    before = lambda c: F.coalesce(F.lag(c).over(W.partitionBy("symbol").orderBy("_chunk")), F.lit(0.0))
    while True:
        due = states.withColumn("_up", before("up_left")).withColumn("_down", before("down_left")).filter("_up <> up OR _down <> down")
        due = due.select("symbol", "_chunk", F.col("_up").alias("up"), F.col("_down").alias("down"))
        if due.isEmpty():
            break
        again, turn = values.join(due, ["symbol", "_chunk"]).mapInPandas(sums, kinds), turn + 1
        states = kept(states.join(due.select("symbol", "_chunk"), ["symbol", "_chunk"], "left_anti").unionByName(again), turn)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` byte"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn")
        return part[given].assign(**{name: kernel(*(part[c].to_numpy(float) for c in inputs), part["_up"].iloc[0], part["_down"].iloc[0])[0]})

    starts = states.select("symbol", "_chunk", F.col("up").alias("_up"), F.col("down").alias("_down"))
    return numbered.join(starts, ["symbol", "_chunk"]).groupBy("symbol", "_chunk").applyInPandas(run, schema)


def _framed(df: DataFrame, feature: Callable[[DataFrame, Sequence[str]], DataFrame], halo: int, rows: int | None) -> DataFrame:
    """A feature over row frames, on chunks where a series is long."""
    return feature(df, PART) if rows is None else in_chunks(df, feature, halo, rows=max(rows, 2 * halo))


def cusum_events(df: DataFrame, k: float = 5.0, n: int = 288, rows: int | None = None) -> DataFrame:
    """cusum_event: returns over their rolling deviation (population, a quarter of n at least), summed on both sides up to k.
    rows: as in with_events."""

    def scores(out: DataFrame, part: Sequence[str]) -> DataFrame:
        out, frame = out.withColumn("_r", F.coalesce(pct_change("close", 1, part), F.lit(0.0))), last_rows(n, part)
        deviation = F.when(F.count("_r").over(frame) >= max(8, n // 4), F.stddev_pop("_r").over(frame))
        return out.withColumn("_z", F.try_divide(F.col("_r"), F.nullif(deviation, F.lit(0.0))))

    out = _framed(df if rows is None else row_numbers(df), scores, n, rows)
    out = with_events(out, "cusum_event", lambda z, *left: K.cusum_from(z, k, *left), ["_z"], rows).drop("_r", "_z")
    return out if "rn" in df.columns else out.drop("rn")


def filter_events(df: DataFrame, n: int = 288, scale: float = 2.0, floor: float = 0.001, legacy: bool = False, rows: int | None = None) -> DataFrame:
    """filter_event of the symmetric filter on log returns. Limit: scale times the mean so far of the rolling deviation
    (legacy: the mean of the whole series, which looks ahead), or floor where unknown. rows: as in with_events."""

    def steps(out: DataFrame, part: Sequence[str]) -> DataFrame:
        out = out.withColumn("_r", F.ln("close") - F.ln(lag("close", 1, part))).withColumn("_p", pct_change("close", 1, part))
        return out.withColumn("_s", std(F.col("_p"), n, None, part))

    out = _framed(df if rows is None else row_numbers(df), steps, n, rows)
    if rows is None:
        frame = W.partitionBy("symbol") if legacy else order().rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn("_m", F.avg("_s").over(frame))
    elif legacy:
        out = out.join(out.groupBy("symbol").agg(F.avg("_s").alias("_m")), "symbol")
    else:
        known = F.col("_s").isNotNull().cast("double")
        out = recurrences(out, {"_total": (F.col("_s"), 1.0), "_count": (known, 1.0)}, rows).withColumn("_m", F.try_divide("_total", F.nullif(F.col("_count"), F.lit(0.0)))).drop("_total", "_count")
    out = out.withColumn("_h", F.coalesce(scale * F.col("_m"), F.lit(floor)))
    out = with_events(out, "filter_event", K.cusum_filter_from, ["_r", "_h"], rows).drop("_r", "_s", "_p", "_m", "_h")
    return out if "rn" in df.columns else out.drop("rn")


def sliding(df: DataFrame, value: Column, width: int, columns: dict[str, Callable[[np.ndarray], np.ndarray]], least: int | None = None, every: int = 1, rows: int = 20_000) -> DataFrame:
    """Adds columns of kernels over the last `width` values at every `every`-th row (null at others, and with fewer than
    `least` known values). Runs on chunks of each series with a halo of width - 1 rows."""
    least, rows = width if least is None else least, max(rows, 2 * width)
    numbered = row_numbers(df.withColumn("_v", value))
    own = F.floor((F.col("rn") - 1) / rows)
    also = F.when((F.col("rn") - 1) % rows >= rows - width + 1, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(also))
    kinds = [(c, t) for c, t in df.dtypes]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds), *(f"`{c}` double" for c in columns)])
    names = [c for c, _ in kinds]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn")
        mine = (part["_own"] == part["_chunk"]).to_numpy() & ((part["rn"].to_numpy() - 1) % every == 0)
        padded = np.concatenate([np.full(width - 1, np.nan), part["_v"].astype(float).to_numpy()])
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)
        ready = np.flatnonzero(mine & ((~np.isnan(windows)).sum(1) >= least))
        out = {}
        for c, f in columns.items():
            values = np.full(len(part), np.nan)
            for a in range(0, len(ready), 2000):
                values[ready[a : a + 2000]] = f(windows[ready[a : a + 2000]])
            out[c] = values
        return part[names].assign(**out)[(part["_own"] == part["_chunk"]).to_numpy()]

    return unknown_to_null(spread.groupBy("symbol", "_chunk").applyInPandas(run, schema), columns)


def range_entropy(df: DataFrame, n: int = 144, bins: int = 9) -> DataFrame:
    return sliding(df.withColumn("_x", pct_change("close")), F.col("_x"), n, {f"price_range_entropy_w{n}": lambda w: K.shannon(K.range_shares(w, bins))}, max(8, n // 4)).drop("_x")


def renyi_entropies(df: DataFrame, n: int = 144, orders: Sequence[float] = (0.5, 2.0), bins: int = 10) -> DataFrame:
    return sliding(df.withColumn("_x", pct_change("close")), F.col("_x"), n, {f"renyi_entropy_q{q}": (lambda w, q=q: K.renyi(K.range_shares(w, bins), q)) for q in orders}).drop("_x")


def complexity(df: DataFrame, n: int = 100, every: int = 1) -> DataFrame:
    """Approximate and sample entropy (m = 2, r a fifth of the window's deviation) and the LZ76 rate of return signs."""
    kernels = {f"apen_w{n}": K.approximate_entropy, f"sampen_w{n}": K.sample_entropy, f"lz76_w{n}": K.lz_entropy}
    return sliding(df.withColumn("_x", pct_change("close")), F.col("_x"), n, kernels, None, every).drop("_x")


def sadf_events(df: DataFrame, every: int = 48, window: int | None = None, least: int = 34, critical: float = -2.86, lags: int = 3, constant: bool = True, trend: bool = True) -> DataFrame:
    """Supremum ADF (log prices) of every `every`-th close over all starts from the beginning of the series, or with
    `window` from that many closes back, carried to the bars between: sadf_log_tstat, sadf_log_crit and sadf_log_break.
    The least window of 34 closes leaves 30 rows to a fit with three lags."""
    picked = row_numbers(df).filter((F.col("rn") - 1) % every == 0).select("symbol", "time", F.ln("close").alias("y"))
    out = as_of(df, _sadf(picked, F.col("y"), "sadf_log_tstat", window, least, lags, constant, trend).drop("y"), ["sadf_log_tstat"])
    out = out.withColumn("sadf_log_tstat", F.coalesce("sadf_log_tstat", F.lit(0.0))).withColumn("sadf_log_crit", F.lit(critical))
    return out.withColumn("sadf_log_break", flag((F.col("sadf_log_tstat") != 0) & (F.col("sadf_log_tstat") > F.col("sadf_log_crit"))))


def sadf_advanced(df: DataFrame, every: int = 48, least: int = 20, lags: int = 2, n: int = 10) -> DataFrame:
    """sadf_events with a critical value by the number of closes taken (-3.75 up to 50, -3.45 up to 100, -3.15 up to 250, else
    -2.86) and sadf_normalized: the score's distance from its mean over the last n in their deviations, 0 where unknown."""
    picked = row_numbers(df).filter((F.col("rn") - 1) % every == 0).select("symbol", "time", F.ln("close").alias("y"))
    taken = F.count("y").over(W.partitionBy("symbol"))
    critical = F.when(taken <= 50, -3.75).when(taken <= 100, -3.45).when(taken <= 250, -3.15).otherwise(-2.86)
    scored = _sadf(picked, F.col("y"), "sadf_log_tstat", None, least, lags, True, True).withColumn("sadf_log_crit", critical)
    t = F.col("sadf_log_tstat")
    scored = scored.withColumn("sadf_normalized", F.try_divide(t - mean(t, n), F.nullif(std(t, n), F.lit(0.0)))).drop("y")
    out = as_of(df, scored, ["sadf_log_tstat", "sadf_log_crit", "sadf_normalized"])
    out = out.withColumn("sadf_log_break", flag(F.col("sadf_log_tstat") > F.col("sadf_log_crit")))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("sadf_log_tstat", "sadf_normalized")})


def sadf_sequence(df: DataFrame, window: int | None = None, least: int = 12) -> DataFrame:
    """Supremum ADF without constant or lags at each bar over all starts from the beginning, or with `window` over the
    last closes only."""
    return _sadf(df, F.col("close"), "sadf", window, least)


def _sadf(df: DataFrame, value: Column, name: str, window: int | None, least: int, lags: int = 0, constant: bool = False, trend: bool = False) -> DataFrame:
    if window is not None:
        return sliding(df, value, window, {name: lambda w: np.array([K.sadf(x, least, lags, constant, trend) for x in w])})
    return by_block_pairs(df, value, name, least, lags, constant, trend)


def by_block_pairs(df: DataFrame, value: Column, name: str, least: int, lags: int = 0, constant: bool = False, trend: bool = False, rows: int = 2048) -> DataFrame:
    """Adds name, the supremum ADF of value at each row over all starts from the beginning of its series; missing values are
    left out.

    A series is cut into blocks of `rows` values. Each pair of a block of ends and an earlier (or the same) block of starts
    is a task of its own that gets these two blocks and the products of all rows between them, some 30 numbers; a row's
    statistic is the largest of its pairs. So no task holds more than two blocks, however long the series, and for n rows
    8 n * n / rows bytes are shuffled.
    """
    given = "rn" in df.columns
    numbered = row_numbers(df)
    known = row_numbers(numbered.select("symbol", "time", F.col("rn").alias("_rn"), value.cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)"), name="_m")
    at = F.col("_m") - 1
    own = F.floor(at / rows)
    also = F.array_compact(F.array(own, F.when((at % rows <= lags) & (own > 0), own - 1)))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("_m", "_v"))), lambda x: x["_v"])
    blocks = known.withColumn("_end", F.explode(also)).groupBy("symbol", "_end").agg(packed.alias("_y")).filter(F.size("_y") > lags + 1)
    folder = work_folder(df.sparkSession, name)
    blocks.write.parquet(f"{folder}/blocks")
    blocks = df.sparkSession.read.schema(blocks.schema).parquet(f"{folder}/blocks")
    size = float(rows + lags + 1)

    def totals(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in parts:
            sums, levels = [], []
            for y in part["_y"]:
                y = np.asarray(y, float)
                x = K.adf_rows(y, lags, constant, trend, y[lags], 0.0, size)
                sums.append((x @ x.T).ravel())
                levels.append(y[lags])
            yield part[["symbol", "_end"]].assign(_sums=sums, _level=levels)

    def between(part: pd.DataFrame) -> pd.DataFrame:
        """For one block of ends: the products of the blocks between it and each earlier one, from near to far."""
        part = part.sort_values("_start", ascending=False)
        end, level = part["_end"].iloc[0], part["_level"].iloc[0]
        total, found = 0.0, []
        for start, sums, own_level in zip(part["_start"], part["_sums"], part["_level"], strict=True):
            m = np.asarray(sums, float)
            side = round(len(m) ** 0.5)
            found.append(np.zeros(len(m)) + np.ravel(total))
            if start < end:
                m = m.reshape(side, side)
                total = total + (K.moved(m, own_level - level, (start - end) * rows / size, trend) if constant else m)
        return part[["symbol", "_end", "_start"]].assign(_y=found)

    spread = F.max("_end").over(W.partitionBy("symbol"))
    kinds = {c: t for c, t in blocks.dtypes}
    sums = blocks.mapInPandas(totals, f"symbol {kinds['symbol']}, _end bigint, _sums array<double>, _level double")
    later = lambda b: b.withColumn("_last", spread).withColumnRenamed("_end", "_start").withColumn("_end", F.explode(F.sequence("_start", "_last"))).drop("_last")
    inner = later(sums).groupBy("symbol", "_end").applyInPandas(between, f"symbol {kinds['symbol']}, _end bigint, _start bigint, _y array<double>")
    starts = later(blocks.select("symbol", "_end", "_y")).filter("_start < _end")
    ends = blocks.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_end"))))
    columns = ["symbol", "_end", "_start", "_y"]
    pairs = ends.select(*columns, F.lit(0).alias("_kind")).unionByName(starts.select(*columns, F.lit(1).alias("_kind"))).unionByName(inner.select(*columns, F.lit(2).alias("_kind")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        held = {k: np.asarray(y, float) for k, y in zip(part["_kind"], part["_y"], strict=True)}
        end, start = int(part["_end"].iloc[0]), int(part["_start"].iloc[0])
        if start == end:
            best = K.sadf_ends(held[0], 0, least, lags, constant, trend)
            place = end * rows + np.arange(len(best)) + 1
        else:
            side = round(len(held[2]) ** 0.5)
            best = K.sadf_between(held[0], held[1], held[2].reshape(side, side), (end - start) * rows, least, lags, constant, trend)
            place = end * rows + lags + 1 + np.arange(len(best)) + 1
        keep = ~np.isnan(best)
        return pd.DataFrame({"symbol": part["symbol"].iloc[0], "_m": place[keep], name: best[keep]})

    found = pairs.groupBy("symbol", "_end", "_start").applyInPandas(run, f"symbol {kinds['symbol']}, _m bigint, `{name}` double")
    best = known.join(found.groupBy("symbol", "_m").agg(F.max(name).alias(name)), ["symbol", "_m"]).select("symbol", F.col("_rn").alias("rn"), name)
    out = numbered.join(best, ["symbol", "rn"], "left").select(*df.columns, *([] if given else ["rn"]), name)
    return out if given else out.drop("rn")
