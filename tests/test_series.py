"""Operators along whole series and over paths, against plain loops; long series in chunks against whole ones."""

import math
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions import windows as win
from tidemark.operators import align, cleaning, labels, metrics, models, recursive, splits
from tidemark.operators import features as X
from tidemark.plans import label_queries
from tidemark.sources import bars as B
from tidemark.sources import files
from tidemark.streaming import streams as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    return B.bars(spark, SF).cache()


@pytest.fixture(scope="module")
def table(bars):
    return {k: v.reset_index(drop=True) for k, v in bars.toPandas().sort_values("time").groupby("symbol")}


def by_symbol(df, *columns):
    return {k: v[list(columns)].reset_index(drop=True) for k, v in df.toPandas().sort_values("time").groupby("symbol")}


def same(a, b, **more):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9, **more)


def series(spark, closes, **columns):
    rows = [("s", i, float(v), *(c[i] for c in columns.values())) for i, v in enumerate(closes)]
    kinds = "".join(f", {k} {'int' if k == 'side' else 'double'}" for k in columns)
    return spark.createDataFrame(rows, f"symbol string, i int, close double{kinds}").withColumn("time", F.timestamp_seconds(F.col("i") * 300))


@pytest.mark.parametrize("rows", [7, 64, 10_000])
def test_recurrences_compose_over_chunks(bars, table, rows):
    x = F.when(F.col("volume") > 20, F.col("close"))
    got = by_symbol(recursive.recurrences(bars, {"a": (x, 0.9), "b": (x, 1.0), "c": (x, 0.3)}, rows), "a", "b", "c")
    for k, t in table.items():
        values = np.where(t["volume"] > 20, t["close"], 0)
        for c, keep in (("a", 0.9), ("b", 1.0), ("c", 0.3)):
            now, out = 0.0, []
            for v in values:
                now = keep * now + v
                out.append(now)
            same(got[k][c], out)


@pytest.mark.parametrize("rows", [None, 50, 10_000])
def test_means_and_oscillators_against_kernels(bars, table, rows):
    assert recursive.chunk_rows(bars, 50) == 50 and recursive.chunk_rows(bars, 10_000) is None
    got = by_symbol(recursive.oscillators(recursive.emas(bars, (5, 20), rows=rows), rows), "ema_5", "ema_20", "atr_14", "rsi_14", "adx_14")
    for k, t in table.items():
        h, lo, c = (t[x].to_numpy() for x in ("high", "low", "close"))
        for name, want in (("ema_5", K.ema(c, 5)), ("ema_20", K.ema(c, 20)), ("atr_14", K.atr(h, lo, c)), ("rsi_14", K.rsi(c)), ("adx_14", K.adx(h, lo, c))):
            same(got[k][name], want)


def test_volatilities_against_pandas(bars, table):
    got = by_symbol(recursive.daily_volatility(labels.daily_change(recursive.target_volatility(bars, 30)), 20), "day_ret", "daily_vol", "target_vol")
    for k, t in table.items():
        ret = []
        for at, close in zip(t["time"], t["close"]):
            past = t[t["time"] <= at - pd.Timedelta(days=1)]
            ret.append(close / past["close"].iloc[-1] - 1 if len(past) else np.nan)
        same(got[k]["day_ret"], ret)
        want = pd.Series(ret).ewm(span=20).std().ffill().bfill()
        np.testing.assert_allclose(got[k]["daily_vol"].astype(float), want, rtol=1e-6)
        h, lo, c = (t[x].to_numpy() for x in ("high", "low", "close"))
        same(got[k]["target_vol"], pd.Series(K.true_range(h, lo, c, 0.0)).ewm(alpha=1 / 30, adjust=False).mean())


@pytest.mark.parametrize("legacy", [False, True])
def test_filter_events_against_a_loop(bars, table, legacy):
    got = by_symbol(recursive.filter_events(bars, 20, legacy=legacy), "filter_event")
    for k, t in table.items():
        c = t["close"].to_numpy()
        deviation = pd.Series(c).pct_change().rolling(20).std()
        limit = np.full(len(c), deviation.mean()) if legacy else deviation.expanding().mean().to_numpy()
        limit = np.where(np.isnan(limit), 0.001, 2 * limit)
        up = down = 0.0
        want = [0]
        for i in range(1, len(c)):
            step = math.log(c[i]) - math.log(c[i - 1])
            up, down, hit = max(0, up + step), min(0, down + step), 0
            if down < -limit[i]:
                hit, down = 1, 0
            elif up > limit[i]:
                hit, up = 1, 0
            want.append(hit)
        assert got[k]["filter_event"].tolist() == want and (legacy or sum(want))


@pytest.mark.parametrize("rows", [23, 100])
def test_events_in_chunks(bars, rows):
    for find, name in ((lambda r: recursive.cusum_events(bars, 3.0, 9, rows=r), "cusum_event"), (lambda r: recursive.filter_events(bars, 9, rows=r), "filter_event"), (lambda r: recursive.filter_events(bars, 9, legacy=True, rows=r), "filter_event")):
        whole, parts = by_symbol(find(None), "time", name), by_symbol(find(rows), "time", name)
        assert sum(t[name].sum() for t in whole.values()) > 20 or name == "filter_event"
        for k, t in whole.items():
            assert parts[k].equals(t)


def test_events_whose_paths_never_meet(spark):
    """No sum is ever taken back, so every chunk waits for all before it."""
    df = series(spark, [1.0] * 40).withColumn("x", F.lit(0.3))
    found = recursive.with_events(df, "hit", lambda x, *left: K.cusum_from(x, 3.2, *left), ["x"], rows=4)
    assert found.columns == [*df.columns, "hit"] and [r["i"] for r in found.filter("hit = 1").orderBy("i").collect()] == [10, 21, 32]
    assert recursive.with_events(df.limit(0), "hit", lambda x, *left: K.cusum_from(x, 3.2, *left), ["x"], rows=4).count() == 0


def test_complexity_against_loops(spark):
    x = np.concatenate([np.random.default_rng(3).normal(size=40).cumsum() + 50, np.full(30, 50.0)])
    got = recursive.complexity(series(spark, x), n=12).orderBy("time").toPandas()
    change = np.append(np.nan, np.diff(x) / x[:-1])

    def matches(w, m, r):
        t = [w[i : i + m] for i in range(len(w) - m + 1)]
        return [sum(max(abs(a - b)) <= r for b in t) / len(t) for a in t]

    def sample(w, r):
        t = [[w[i : i + m] for i in range(len(w) - 2)][: len(w) - m + 1] for m in (2, 3)]
        b, a = (sum(max(abs(p - q)) <= r for i, p in enumerate(u) for j, q in enumerate(u) if i != j) for u in t)
        return -math.log(a / b) if a and b else math.nan

    def rate(codes):
        total = 0
        for i in range(len(codes)):
            n = 1
            while i + n <= len(codes) and any(codes[j : j + n] == codes[i : i + n] for j in range(max(0, i - n), i)):
                n += 1
            total += n
        return len(codes) * math.log(len(codes)) / total

    for i in range(len(x)):
        w = change[i - 11 : i + 1] if i >= 12 else None
        if w is None or np.std(w) == 0:
            assert w is None or got.loc[i, ["apen_w12", "sampen_w12"]].isna().all()
            continue
        r = 0.2 * np.std(w, ddof=1)
        want = np.mean(np.log(matches(w, 2, r))) - np.mean(np.log(matches(w, 3, r)))
        assert got["apen_w12"][i] == pytest.approx(want, abs=1e-9)
        assert got["sampen_w12"][i] == pytest.approx(sample(w, r), abs=1e-9, nan_ok=True)
        assert got["lz76_w12"][i] == pytest.approx(rate((np.sign(w) + 1).astype(int).tolist()), abs=1e-9)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("days", [None, 1, 3])
def test_as_of_by_spans(bars, forward, days):
    right = bars.filter("hour(time) % 5 = 0").withColumn("close", F.when(F.minute("time") > 10, F.col("close"))).withColumnRenamed("close", "other")
    got = align.as_of(bars, right, ["other", "volume"] if False else ["other"], forward=forward, days=days).toPandas()
    a, b = bars.toPandas().sort_values("time"), right.toPandas().sort_values("time")
    want = pd.merge_asof(a, b[["symbol", "time", "other"]], on="time", by="symbol", direction="forward" if forward else "backward")
    key = ["symbol", "time"]
    pd.testing.assert_series_equal(got.sort_values(key)["other"].reset_index(drop=True), want.sort_values(key)["other"].reset_index(drop=True))


def plain_barriers(close, side, trgt, horizon, pt, sl):
    out = {}
    for i in range(len(close) - 1):
        if np.isnan(trgt[i]):
            continue
        path = [((close[j] / close[i] - 1) * side[i] if close[i] else None, j) for j in range(i + 1, min(i + horizon, len(close) - 1) + 1)]
        hit = next(((m, j, 1 if m >= pt * trgt[i] else -1) for m, j in path if m is not None and (m >= pt * trgt[i] or m <= -sl * trgt[i])), None)
        out[i] = hit or (path[-1][0], path[-1][1], 0)
    return out


@pytest.mark.parametrize("rows", [20, 10_000])
def test_barrier_labels_with_a_close_of_zero(spark, rows):
    r = np.random.default_rng(7)
    close = np.abs(r.normal(size=150).cumsum()).round(1)
    close[[0, 40, 77, 149]] = 0
    side, trgt = r.choice([-1, 1], 150), np.where(r.random(150) < 0.1, np.nan, 0.3)
    df = series(spark, close, side=[int(v) for v in side], trgt=[None if np.isnan(v) else float(v) for v in trgt])
    got = labels.barrier_labels(df, 15, 1.5, 1.0, F.col("trgt").isNotNull(), rows)
    found = {x["i"]: (x["ret"], int(x["t1"].timestamp()) // 300, x["bin"]) for x in got.collect()}
    want = plain_barriers(close, side, trgt, 15, 1.5, 1.0)
    assert found.keys() == want.keys() and found[40][0] is None and found[40][2] == 0
    for i, (ret, at, kind) in want.items():
        assert found[i][1:] == (at, kind) and found[i][0] == (ret if ret is None else pytest.approx(ret, abs=1e-12))


def test_label_queries_with_a_close_of_zero(bars):
    df = win.row_numbers(bars).withColumn("close", F.when(F.col("rn") == 120, 0.0).otherwise(F.col("close"))).drop("rn").withColumn("low", F.least("low", "close"))
    zero = label_queries.events_with_side(df).filter("close = 0")
    assert zero.count() > 0 and zero.filter("ret IS NOT NULL OR bin <> 0").count() == 0
    assert label_queries.touched(df).count() == bars.count()
    assert labels.trend_scan(df, 40, every=1).filter("ret IS NULL").count() > 0
    assert labels.binary_meta_label(F.lit(1), F.col("bin")) is not None
    assert labels.short_recode(label_queries.events_with_side(df)).count() > 0


def test_first_over_and_moments_against_loops():
    r = np.random.default_rng(12)
    for n in (1, 2, 7, 64, 200):
        x = r.integers(0, 40, n).astype(float)
        x[r.random(n) < 0.1] = np.nan
        level = np.where(r.random(n) < 0.1, np.nan, x + r.integers(-3, 30, n))
        for most in (1, 5, 1000):
            want = [next((j - i for j in range(i + 1, min(i + most, n - 1) + 1) if x[j] >= level[i]), 0) for i in range(n)]
            assert K.FirstOver(x).after(level, most).tolist() == want
    x = r.normal(5, 1, 300)
    x[[3, 50, 51]], x[120:140] = np.nan, 7.0
    for width in (7, 15, 100):
        s = pd.Series(x)
        skew, kurtosis = K.skewness_kurtosis(x, width)
        flat = s.rolling(width).std() < 1e-9
        np.testing.assert_allclose(skew[~flat], s.rolling(width).skew()[~flat], rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(kurtosis[~flat], s.rolling(width).kurt()[~flat], rtol=1e-6, atol=1e-8)
        assert np.isnan(skew[flat]).all()


def test_rolling_quantiles_against_sorting():
    r = np.random.default_rng(13)
    x = r.integers(0, 9, 200).astype(float)
    x[[4, 60, 61]] = np.nan
    for width in (1, 5, 20):
        for share, found in zip((0.25, 0.5, 0.95), K.rolling_quantiles(x, width, (0.25, 0.5, 0.95)), strict=True):
            np.testing.assert_allclose(found, pd.Series(x).rolling(width).quantile(share), rtol=1e-12)


def test_trend_scan_in_chunks(bars, table):
    whole = labels.trend_scan(bars, 40, every=3).orderBy("symbol", "time").toPandas()
    parts = labels.trend_scan(bars, 40, every=3, rows=50).orderBy("symbol", "time").toPandas()
    pd.testing.assert_frame_equal(whole, parts)
    x = whole.iloc[20]
    t = table[x["symbol"]]
    i = int(t.index[t["time"] == x["time"]][0])
    fits = {}
    for n in range(5, 40):
        y, k = t["close"].to_numpy()[i : i + n], np.arange(n)
        slope, level = np.polyfit(k, y, 1)
        error = np.sqrt(((y - level - slope * k) ** 2).sum() / (n - 2) / ((k - k.mean()) ** 2).sum())
        fits[n] = slope / (error + 1e-8)
    best = max(fits, key=lambda n: abs(fits[n]))
    assert (x["length"], x["t_value"]) == (best, pytest.approx(fits[best], rel=1e-6))


def test_running_product_of_any_sign(spark):
    growth = [1.0, 1.1, -0.5, 1.1, -2.0, 0.0, 3.0]
    df = series(spark, np.array(growth))
    got = [r["p"] for r in df.withColumn("p", win.running_product(F.col("close"))).orderBy("time").collect()]
    assert got == pytest.approx(np.cumprod(growth).tolist())


def test_threshold_search_against_all_thresholds(spark):
    r = np.random.default_rng(3)
    y, p, ret, side = (r.random(100) < 0.4).astype(int), r.random(100).round(2), r.normal(0, 0.01, 100), r.choice([-1, 1], 100)
    df = spark.createDataFrame([("a", float(a), float(b), int(c), int(d)) for a, b, c, d in zip(p, ret, side, y, strict=True)], "g string, p double, r double, s int, y int")
    for metric in ("f1", "sharpe", "sortino"):
        best, kept = -np.inf, None
        for i in range(18):
            t = round(0.05 + 0.05 * i, 10)
            chosen = p > t
            if metric == "f1":
                score = 2 * (chosen & (y == 1)).sum() / max(chosen.sum() + y.sum(), 1)
            else:
                x = chosen * side * ret
                down = x.std() if metric == "sharpe" else x[x < 0].std() if (x < 0).any() else 0
                score = x.mean() / down * (252 * 288) ** 0.5 if down > 1e-12 else 0
            if score > best + 1e-9:
                best, kept = score, (t, int(chosen.sum()))
        got = metrics.threshold_search(df, "g", "p", "r", "s", "y", metric).first()
        assert (got["threshold"], got["n"], got["score"]) == (*kept, pytest.approx(best))


def test_left_join_of_labels(spark):
    x = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0)], "symbol string, time int, v double")
    y = spark.createDataFrame([("a", 1, 9.0, 3), ("c", 1, 9.0, 4)], "symbol string, time int, v double, label int")
    out = align.with_labels(x, y)
    assert out.columns == ["symbol", "time", "v", "label"] and sorted(map(tuple, out.collect())) == [("a", 1, 5.0, 3), ("b", 2, 6.0, None)]


def test_first_touch_in_chunks(bars):
    df = bars.withColumn("pt_dist", F.lit(15.0)).withColumn("sl_dist", F.lit(10.0))
    columns = ("long_hit_1R_h12", "short_hit_1R_h12", "long_hit_2R_h30")
    make = lambda x, part: labels.first_touch(x, (12, 30), (1.0, 2.0), part=part)
    whole, parts = by_symbol(make(df, win.PART), *columns), by_symbol(win.in_chunks(df, make, ahead=30, rows=40), *columns)
    for k, t in whole.items():
        assert t.equals(parts[k]) and t.to_numpy().any()


CHUNKED = [(X.volume_regime, 24, {"n": 25}), (X.distribution, 40, {"n": 15, "long": 25}), (X.volatility_regime, 30, {"n": 15}), (X.fractal_dimension, 30, {"windows": (14, 30)}), (X.liquidity, 16, {"n": 15}), (X.sign_entropy, 31, {"n": 30}), (X.permutation_entropy, 30, {"n": 30}), (X.power_means, 31, {"n": 30}), (X.one_sided_deviation, 40, {"n": 20}), (X.z_score_event, 19, {"n": 20}), (X.excursions, 19, {"n": 20})]


@pytest.mark.parametrize(("feature", "halo", "options"), CHUNKED, ids=[x[0].__name__ for x in CHUNKED])
def test_row_frames_in_chunks(bars, feature, halo, options):
    whole = feature(bars, **options)
    columns = [f"`{c}`" for c in whole.columns if c not in bars.columns]
    parts = win.in_chunks(bars, lambda df, part: feature(df, part=part, **options), halo, rows=50)
    row = lambda df: df.orderBy("symbol", "time").select(*(F.col(c).cast("double") for c in columns)).toPandas()
    a, b = row(whole), row(parts)
    assert a.notna().any().all() and (a.isna() == b.isna()).all().all()
    np.testing.assert_allclose(a.fillna(0), b.fillna(0), rtol=1e-7, atol=1e-8)


def test_adf_with_lags_against_least_squares(bars, table):
    for lags, constant, trend in ((0, False, False), (2, True, False), (3, True, True)):
        got = {r["symbol"]: (r["t_stat"], r["n"]) for r in X.adf(bars, lags, constant, trend).collect()}
        for k, t in table.items():
            assert got[k] == (pytest.approx(K.adf_t(t["close"].to_numpy(), lags, constant, trend), rel=1e-6), len(t) - 1 - lags)


def test_advanced_sadf_against_a_loop(bars, table):
    got = by_symbol(recursive.sadf_advanced(bars, every=4, least=20, lags=1, n=5), "sadf_log_tstat", "sadf_log_crit", "sadf_normalized", "sadf_log_break")
    for k, t in table.items():
        y = np.log(t["close"].to_numpy()[::4])
        scores = pd.Series([K.sadf(y[: i + 1], 20, 1, True, True) if i >= 19 else np.nan for i in range(len(y))])
        z = (scores - scores.rolling(5).mean()) / scores.rolling(5).std()
        at = np.arange(len(t)) // 4
        np.testing.assert_allclose(got[k]["sadf_log_tstat"], scores.fillna(0)[at], rtol=1e-5, atol=1e-9)
        np.testing.assert_allclose(got[k]["sadf_normalized"], z.fillna(0)[at], rtol=1e-3, atol=1e-6)
        limit = -3.75 if len(y) <= 50 else -3.45
        assert set(got[k]["sadf_log_crit"]) == {limit} and got[k]["sadf_log_break"].tolist() == (scores[at] > limit).astype(int).tolist()


def test_streams_read_a_file_and_a_folder(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for run, make in enumerate((lambda t: ST.running_ema(t, 5), lambda t: ST.running_cusum(t, 300.0, 50.0))):
        one = ST.run_to_table(make(ST.tick_stream(spark, SF)), "one", ("event_id",), "append").toPandas().sort_values(["symbol", "ts", "event_id"])
        assert len(one) == events.count()
        ticks = B.ticks(spark, SF).toPandas().sort_values(["symbol", "ts", "event_id"])
        want = []
        for _, t in ticks.groupby("symbol"):
            if run == 0:
                want += t["value"].ewm(span=5, adjust=False).mean().tolist()
            else:
                up = down = 0.0
                for v in t["value"]:
                    up, down = max(0, up + v - 50), min(0, down + v - 50)
                    hit = up > 300 or down < -300
                    want.append(int(hit))
                    up, down = (0.0, 0.0) if hit else (up, down)
        same(one["ema" if run == 0 else "event"], want)


def test_streams_take_shuffled_files_one_a_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    ticks = ST.tick_stream(spark, str(tmp_path), 1)
    assert rows(ST.streamed_bars(ticks)) == rows(B.bars(spark, SF).select("symbol", "time", *B.OHLCV))
    again = ticks.unionAll(ST.tick_stream(spark, SF))
    found = ST.streamed_distinct(again)
    assert rows(found.select("event_id", "symbol", "value")) == rows(B.ticks(spark, SF).select("event_id", "symbol", "value"))
    late = ST.run_to_table(ST.bar_stream(ST.tick_stream(spark, str(tmp_path))), "whole", ("symbol", "time"))  # all at once: nothing is late
    assert late.count() == B.bars(spark, SF).count()


def test_running_state_goes_from_batch_to_batch(spark, tmp_path):
    """Batches in the order of time, of which one lacks a symbol; equal to the stateful stream over one file."""
    days = spark.read.parquet(f"{SF}/events.parquet").withColumn("d", F.floor((F.dayofmonth("ts") - 1) / 8)).filter("NOT (d = 1 AND event_type = 'click')")
    days.drop("d").coalesce(1).write.parquet(str(tmp_path / "whole" / "events.parquet"))
    for d in range(4):
        days.filter(F.col("d") == d).drop("d").coalesce(1).write.mode("append").parquet(str(tmp_path / "parts" / "events.parquet"))
    rows = lambda df, c: sorted((r["symbol"], r["ts"], r["event_id"], r[c]) for r in df.collect())
    whole, parts = ST.tick_stream(spark, str(tmp_path / "whole")), ST.tick_stream(spark, str(tmp_path / "parts"), 1)
    for column, stateful, bounded in (("ema", ST.running_ema(whole, 5), lambda t: ST.streamed_ema(t, 5)), ("event", ST.running_cusum(whole, 300.0, 50.0), lambda t: ST.streamed_cusum(t, 300.0, 50.0))):
        want = rows(ST.run_to_table(stateful, column, ("event_id",), "append"), column)
        assert len(want) == days.count() and rows(bounded(whole), column) == want and rows(bounded(parts), column) == want


def test_running_state_holds_a_piece_at_a_time(spark):
    """The caller of a step holds no more rows than an Arrow batch has, where the stateful stream holds all of a symbol."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    ticks = ST.tick_stream(spark, SF)
    try:
        for bounded in (True, False):
            more = spark.sparkContext.accumulator(0)

            def step(state, v, more=more):
                more.add(int(len(sys._getframe(1).f_locals["rows"]) > 50))
                return state, (v,)

            args = {"x": "double"}, (0.0,), step
            found = ST.streamed_running(ticks, "x", *args) if bounded else ST.run_to_table(ST.running(ticks, *args), "x", ("event_id",), "append")
            assert found.count() == B.ticks(spark, SF).count() and (more.value == 0) == bounded
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stream_without_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert ST.streamed_bars(ST.tick_stream(spark, str(tmp_path))).count() == 0


def test_stores(spark, bars, tmp_path):
    path = str(tmp_path / "store")
    files.replace_partitions(bars, path)
    files.snapshot(spark, path, str(tmp_path / "copy"))
    new = bars.filter("symbol = 'view'").limit(4).withColumn("volume", F.lit(-1.0)).withColumn("more", F.lit(1))
    files.merge_partitions(spark, new, path, str(tmp_path / "work"))
    merged = files.stored(spark, path)
    assert merged.count() == bars.count() and merged.filter("volume = -1").count() == 4
    assert files.stored(spark, path, "view").filter("volume = -1").count() == 4
    assert spark.read.parquet(str(tmp_path / "copy")).filter("volume = -1").count() == 0
    files.report(metrics.mean_absolute(bars, ["open", "close"]), str(tmp_path / "report"))
    files.report(cleaning.known_counts(bars, ["open"]), str(tmp_path / "json"), "json")
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 2 and spark.read.json(str(tmp_path / "json")).count() == 5
    assert cleaning.columns_like(X.returns(bars), "ret") == ["ret", "log_ret", "ret_sign", "ret_abs"]
    spark.sql("CREATE TABLE IF NOT EXISTS old_features (x INT) USING parquet")
    assert files.clear_tables(spark) == ["old_features"]


def test_models_have_their_settings(spark, bars):
    assert models.binary_model(["x"], "y", "deep").getStages()[1].getMaxIter() == 500
    assert models.multiclass_model(["x"], "y").getStages()[1].getNumTrees() == 200
    rows = bars.withColumn("up", (F.col("close") > F.col("open")).cast("double")).withColumn("gap", F.col("close") - F.col("open"))
    model = models.binary_model(["gap"], "up", maxIter=2).fit(rows)
    again = models.saved(model, ST.work_folder(spark, "model"))
    assert again.transform(rows).filter("prediction <> up").count() == 0
    folds = splits.purged_past(rows.withColumn("t1", F.col("time")), 3)
    assert folds.filter("split = 0 AND role = 'train'").count() == 0 and folds.filter("split = 2 AND role = 'train'").count() > 0


def test_data_set_is_features_with_labels(spark, bars, table):
    from tidemark.plans import master

    got = master.data_set(bars, window=30, every=4, pt=1.5, sl=1.0, work=ST.work_folder(spark, "data-set")).toPandas()
    assert set(got.columns) > {"ema_20", "atr_14", "cusum_event_rate_w1440", "sadf_log_tstat", "fractal_dim_60", "returns_skew_rolling"} and len(got.columns) > 75
    scans = labels.strong_trends(labels.trend_scan(bars, 30, every=4)).toPandas().set_index(["symbol", "time"])
    vol = by_symbol(recursive.daily_volatility(labels.daily_change(bars), 50), "daily_vol")
    found, wanted = got.set_index(["symbol", "time"]), 0
    for (k, at), event in scans.iterrows():
        t = table[k]
        i, c, times = int(t.index[t["time"] == at][0]), t["close"].to_numpy(), t["time"]
        later = [j for j in range(i + 1, len(t)) if times[j] >= at + pd.Timedelta(days=5)]
        end = later[0] if later else len(t) - 1
        trgt = vol[k]["daily_vol"][i]
        path = [((c[j] / c[i] - 1) * event["side"], j) for j in range(i + 1, end + 1)]
        hit = next(((m, j, 1 if m >= 1.5 * trgt else -1) for m, j in path if m >= 1.5 * trgt or m <= -trgt), (path[-1][0], path[-1][1], 0) if later else None)
        if hit is None:
            assert (k, at) not in found.index
            continue
        x, wanted = found.loc[(k, at)], wanted + 1
        assert (x["ret"], x["t1"], x["trgt"], x["side"]) == (pytest.approx(hit[0]), times[hit[1]], pytest.approx(trgt), event["side"]) and x["bin"] == (-np.sign(hit[0]) if x["side"] < 0 else hit[2])
    assert wanted == len(got) > 20
