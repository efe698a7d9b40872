"""Properties of bar operators: independent recomputation, no overlap, no look-ahead, conserved equity."""

import math
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions import windows as win
from tidemark.operators import align, backtest, cleaning, labels, metrics, recursive, splits
from tidemark.operators import features as X
from tidemark.plans import master
from tidemark.sources import bars as B
from tidemark.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    return B.bars(spark, SF).cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in ("symbol", "time", *columns)) for r in df.collect())


def test_dedupe_is_idempotent(bars):
    once = cleaning.ranked_dedupe(B.dirty_bars(bars))
    assert rows(once, "volume") == rows(cleaning.ranked_dedupe(once), "volume")
    assert once.count() == once.select("symbol", "time").distinct().count()


def test_strict_validation_raises(bars):
    bad = bars.withColumn("batch", F.lit(0)).withColumn("low", F.col("high") + 1)
    with pytest.raises(Exception, match="breaks the rules"):
        cleaning.validate_bars(bad, strict=True).collect()
    assert cleaning.quarantine(bad).count() == bars.count()


def test_chunks_give_the_same_as_whole_series(bars):
    whole = X.liquidity(X.sign_entropy(bars, 40), 30)
    parts = win.in_chunks(bars, lambda df, part: X.liquidity(X.sign_entropy(df, 40, part), 30, part), halo=41, rows=64)
    a = pd.DataFrame(rows(whole, "shannon_entropy_sign_w40", "kyle_lambda_w30", "roll_spread_w30"))
    b = pd.DataFrame(rows(parts, "shannon_entropy_sign_w40", "kyle_lambda_w30", "roll_spread_w30"))
    assert (a[[0, 1]] == b[[0, 1]]).all().all()
    np.testing.assert_allclose(a[[2, 3, 4]].astype(float), b[[2, 3, 4]].astype(float), rtol=1e-7, atol=1e-9)


def test_features_do_not_look_ahead(bars):
    cut = bars.filter("time < timestamp'2024-01-20'")
    build = lambda df: recursive.cusum_events(recursive.filter_events(X.volatility_regime(recursive.trend(df)), 40))
    columns = ("ema_20", "volatility_regime", "cusum_event", "filter_event")
    late = [r for r in rows(build(bars), *columns) if r[1] < pd.Timestamp("2024-01-20")]
    assert late == rows(build(cut), *columns)


def test_ema_is_seeded_by_the_mean():
    x = np.arange(1.0, 31.0) ** 1.5
    out = K.ema(x, 5)
    expected = x[:5].mean()
    assert np.isnan(out[:4]).all() and out[4] == pytest.approx(expected)
    for i in range(5, 30):
        expected += (x[i] - expected) / 3
        assert out[i] == pytest.approx(expected)


def test_rsi_and_adx_stay_in_bounds():
    r = np.random.default_rng(1)
    close = 100 + r.normal(size=300).cumsum()
    for out in (K.rsi(close), K.adx(close + 1, close - 1, close)):
        known = out[~np.isnan(out)]
        assert len(known) > 200 and known.min() >= 0 and known.max() <= 100


def test_entropies_of_known_windows():
    flat = np.ones((1, 20))
    assert K.shannon(K.range_shares(flat, 9))[0] == 0
    even = np.arange(20.0)[None]
    assert K.shannon(K.range_shares(even, 10))[0] == pytest.approx(math.log2(10))
    assert K.renyi(K.range_shares(even, 10), 2.0)[0] == pytest.approx(math.log(10))
    assert K.renyi(K.range_shares(even, 10), 1.0)[0] == pytest.approx(math.log(10))
    wave = np.tile([1.0, -1.0], 40)[None]
    noise = np.random.default_rng(3).normal(size=(1, 80))
    assert K.approximate_entropy(wave)[0] < K.approximate_entropy(noise)[0]
    assert K.lz_entropy(np.ones((1, 80)))[0] < K.lz_entropy(noise)[0]


def test_sadf_of_an_explosive_series_is_high():
    r = np.random.default_rng(5)
    walk = r.normal(size=80).cumsum() + 50
    boom = np.concatenate([walk[:50], walk[50] * 1.05 ** np.arange(30)])
    assert K.sadf(boom, 12, constant=True) > K.sadf(walk, 12, constant=True)
    assert K.adf_t(np.array([1.0, 2, 3]), 5) != K.adf_t(np.array([1.0, 2, 3]), 5)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-3, 3), max_size=60), st.floats(0.5, 6))
def test_cusum_fires_only_beyond_its_limit(values, k):
    events = K.cusum(np.array(values), k)
    up = down = 0.0
    for v, e in zip(values, events, strict=True):
        up, down = max(0.0, up + v), min(0.0, down + v)
        assert e == (up > k or down < -k)
        if e:
            up = down = 0.0


def test_first_touch_ties(spark):
    path = [("s", i, 10.0, h, lo) for i, (h, lo) in enumerate([(10.0, 10.0), (12.0, 8.0), (10.0, 10.0), (10.0, 10.0)])]
    df = spark.createDataFrame(path, "symbol string, t int, close double, high double, low double").withColumn("time", F.timestamp_seconds("t")).withColumn("pt_dist", F.lit(1.0)).withColumn("sl_dist", F.lit(1.0))
    first = labels.first_touch(df, [2], [1.0]).orderBy("time").first()
    assert (first["long_hit_1R_h2"], first["short_hit_1R_h2"]) == (1, 0)
    other = labels.first_touch(df, [2], [1.0], tie_long="stop", tie_short="target").orderBy("time").first()
    assert (other["long_hit_1R_h2"], other["short_hit_1R_h2"]) == (0, 1)


def test_purged_folds_never_overlap(bars):
    df = bars.withColumn("t1", F.coalesce(F.lead("time", 6).over(win.order()), F.col("time")))
    numbered = win.row_numbers(df).withColumn("row", F.col("rn") - 1).select("symbol", "row", "time", "t1").toPandas().set_index(["symbol", "row"])
    out = splits.purged_kfold(df, 4).toPandas()
    for (symbol, _), part in out.groupby(["symbol", "split"]):
        train, test = (numbered.loc[symbol].loc[part[part["role"] == r]["row"]] for r in ("train", "test"))
        lo, hi = test["time"].min(), test["t1"].max()
        assert len(test) and not ((train["time"] <= hi) & (train["t1"] >= lo)).any()
        assert not set(train.index) & set(test.index)


def test_equity_is_cash_plus_profits(bars):
    signals = backtest.hold_signals(bars.withColumn("long_label", (F.col("volume") % 10) / 10).withColumn("short_label", (F.col("close") % 10) / 10), 0.6, 0.8, 5)
    out = backtest.event_backtest(signals).toPandas().sort_values("time")
    for _, part in out.groupby("symbol"):
        profit = part["pnl"].fillna(0).cumsum()
        flat = part["position"].shift(1, fill_value=0) == 0
        np.testing.assert_allclose(part["equity"][flat], 100_000 + profit.shift(1, fill_value=0)[flat])
        assert part["pnl"].notna().sum() > 3


def test_metrics_without_losses(spark):
    trades = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "symbol string, pnl double")
    assert metrics.trade_metrics(trades).first()["profit_factor"] == math.inf


def test_as_of_keeps_nulls_of_the_newest_row(spark):
    left = spark.createDataFrame([("a", 5), ("a", 15), ("b", 1)], "symbol string, time int")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 10, None)], "symbol string, time int, v double")
    assert sorted(align.as_of(left, right, ["v"]).collect()) == [("a", 5, 1.0), ("a", 15, None), ("b", 1, None)]


def test_sequence_batches(spark):
    df = spark.range(30).select(F.lit("s").alias("symbol"), F.timestamp_seconds("id").alias("time"), F.col("id").cast("double").alias("x"))
    out = labels.sequence_windows(df, ["x"], 10, 8)
    assert [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()] == [8, 8, 5]


def test_master_pipeline_has_all_columns(bars):
    out = master.all_features(bars, windows=(24, 48), breaks=(48, 96))
    names = master.feature_names(out, bars)
    assert len(names) >= 70 and len(set(names)) == len(names)
    assert {"ema_algnment", "ema20_h4", "sadf_log_break", "renyi_entropy_q0.5", "time_since_last_event_w96", "volatility_stress"} <= set(names)


def test_master_pipeline_in_chunks(bars, tmp_path):
    # Means and events in chunks of a part of a series give what whole series give.
    settings = {"windows": (24, 48), "breaks": (48, 96)}
    few = bars.filter("symbol in ('click', 'view')")
    whole = master.all_features(few, work=str(tmp_path / "whole"), **settings)
    parts = master.all_features(few, work=str(tmp_path / "parts"), rows=60, event_rows=50, **settings)
    assert (tmp_path / "parts" / "filtered").exists() and not (tmp_path / "whole" / "filtered").exists()
    names = master.feature_names(whole, few)
    assert parts.columns == whole.columns
    a, b = ([tuple(math.nan if r[c] is None else float(r[c]) for c in names) for r in x.orderBy("symbol", "time").collect()] for x in (whole, parts))
    assert len(a) == few.count() > 120
    for x, y in zip(a, b, strict=True):
        assert y == pytest.approx(x, rel=1e-6, abs=1e-9, nan_ok=True)


def test_csv_round_trip(spark, bars, tmp_path):
    text = ["Date;Time;Open;High;Low;Close;Vol", "2024-01-01;0:05;1,000.5;1001;999;1000;7", "20240101;00:10;1;2;0.5;1.5;nan", "2024-01-01;00:11;1;2;0.5;1.5;3", "bad;00:15;1;2;0.5;1.5;3"]
    path = tmp_path / "x.csv"
    path.write_text("\n".join(text))
    out = files.read_headed_csv(spark, str(path), "eur").orderBy("time").collect()
    assert [(r["open"], r["volume"], r["time"].minute) for r in out] == [(1000.5, 7.0, 5), (1.0, None, 10)]
    plain = tmp_path / "y.csv"
    plain.write_text("2024.01.01,00:05,1,2,0.5,1.5,9,8,3\nbad,row,1,2,0.5,1.5,9,8,3\n")
    assert [(r["volume"], r["spread"]) for r in files.read_plain_csv(spark, str(plain), "eur").collect()] == [(8.0, 3.0)]
    files.replace_partitions(bars, str(tmp_path / "store"))
    files.replace_partitions(bars.filter("symbol = 'view'").limit(3), str(tmp_path / "store"))
    kept = {r["symbol"]: r["count"] for r in spark.read.parquet(str(tmp_path / "store")).groupBy("symbol").count().collect()}
    assert kept["view"] == 3 and len(kept) == 5


def test_catalog_helpers(spark, bars):
    bars.createOrReplaceTempView("m5_bars")
    found = {r["name"]: r for r in files.inspect(spark).collect()}
    assert found["m5_bars"]["rows"] == bars.count() and files.bar_tables(spark) == ["m5_bars"]
    both = bars.withColumn("timeframe", F.when(F.minute("time") == 0, "H1").otherwise("M5"))
    held = {(r["symbol"], r["timeframe"]): r["rows"] for r in files.timeframes(both).collect()}
    assert sum(held.values()) == bars.count() and held["click", "H1"] == bars.filter("symbol = 'click' AND minute(time) = 0").count()
    assert {(r["timeframe"], r["rows"]) for r in files.timeframes(bars.filter("symbol = 'view'")).collect()} == {(None, bars.filter("symbol = 'view'").count())}
    assert files.sample(bars, 10).count() == 10 and rows(files.sample(bars, 10)) == rows(files.sample(bars, 10))
    source = files.broker_bars(spark, "eur", 12_000)
    assert source.count() == source.distinct().count() == 12_000 and source.rdd.getNumPartitions() == 3


def test_concentration_in_any_order_of_rows(spark):
    # 0.2178125 is a half at the sixth digit; sums of shares are just under it in 40 of the 120 orders of rows.
    weights = [(t, str(i), float(v)) for t, vs in enumerate(permutations((79, 202, 174, 117, 148))) for i, v in enumerate(vs)]
    weights += [(200, "a", None), (200, "b", 3.0), (200, "c", 1.0), (201, "a", 0.0), (201, "b", None)]
    found = {r["time"]: r for r in X.concentration(spark.createDataFrame(weights, "time int, asset string, weight double").coalesce(1)).collect()}
    assert {found[t]["hhi"] for t in range(120)} == {0.2178125}
    assert found[200]["hhi"] == 0.625 and found[200]["normalized_concentration"] == 0.25 and found[201]["hhi"] is None
