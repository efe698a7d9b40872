"""Operators that look at a whole series, against brute force over all earlier rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels as K
from tidemark.functions import windows as win
from tidemark.operators import features as X
from tidemark.operators import recursive as R


def series(spark, values):
    rows = [(s, i, float(v)) for s, y in values.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "symbol string, i int, close double").select("symbol", F.timestamp_seconds(F.col("i") * 300).alias("time"), "close")


def by_row(df, *columns):
    return {(r["symbol"], int(r["time"].timestamp()) // 300): [r[c] for c in columns] for r in df.collect()}


def brute_csw(close, two_sided):
    y, out = np.log(close), [(None, None)] * 2
    for t in range(2, len(y)):
        variance = (np.diff(y[: t + 1]) ** 2).sum() / (t - 1)
        rise = [abs(y[t] - y[s]) if two_sided else y[t] - y[s] for s in range(t)]
        score, back = max((x / (variance * math.sqrt(t - s)), t - s) for s, x in enumerate(rise))
        out.append((score, math.sqrt(4.6 + math.log(back))))
    return out


def test_csw_takes_all_earlier_rows(spark):
    r = np.random.default_rng(1)
    values = {"jump": np.exp(np.append(r.normal(0, 0.001, 100), 0.2 * np.arange(1, 5).repeat(60) + r.normal(0, 0.001, 240))), "walk": np.exp(r.normal(0, 0.01, 1300).cumsum())}
    for two_sided in (False, True):
        found = by_row(X.csw_statistic(series(spark, values), two_sided=two_sided), "csw_stat", "csw_crit")
        near = by_row(X.csw_statistic(series(spark, {"jump": values["jump"][:40]}), 64, two_sided), "csw_stat", "csw_crit")
        far = 0
        for s, close in values.items():
            for t, want in enumerate(brute_csw(close, two_sided)):
                assert found[s, t] == (pytest.approx(list(want), rel=1e-9) if t > 1 else [None, None])
                assert s != "jump" or t > 39 or near[s, t] == (pytest.approx(list(want), rel=1e-9) if t > 1 else [None, None])
                far += t > 1 and want[1] > math.sqrt(4.6 + math.log(64))
        assert far > 100  # references that a window of 64 rows would miss


def test_csw_from_references_alone(spark):
    # Chunks of 16 rows, of which later ones get only what can be a best reference: ties, gaps, falling and rising series.
    r = np.random.default_rng(9)
    walk = np.exp(np.round(np.cumsum(r.normal(size=150)), 1) / 50)
    values = {"walk": walk, "flat": np.ones(60), "down": np.exp(-np.arange(80) / 100), "up": np.exp(np.arange(80) / 100), "gaps": np.where(r.random(120) < 0.2, 0.0, walk[:120])}
    for two_sided in (False, True):
        whole, parts = (by_row(X.csw_statistic(series(spark, values), two_sided=two_sided, rows=n), "csw_stat", "csw_crit") for n in (4096, 16))
        assert whole.keys() == parts.keys()
        for k, want in whole.items():
            assert [x is None for x in parts[k]] == [x is None for x in want] and parts[k] == [x if x is None else pytest.approx(x, rel=1e-9) for x in want]
        y = np.log(walk)
        assert K.csw_references(y, two_sided).sum() < 0.4 * len(y)


def test_csw_by_hand(spark):
    y = [0, 0.1, 0.05, 0.2, 0.1]
    found = by_row(X.csw_statistic(series(spark, {"a": np.exp(y)})), "csw_stat")
    assert found["a", 2] == [pytest.approx(0.05 / (0.0125 * 2**0.5))]
    assert by_row(X.csw_statistic(series(spark, {"a": np.exp(y)}), two_sided=True), "csw_stat")["a", 2] == [pytest.approx(4.0)]


def test_chunks_of_a_series_see_its_whole_past(spark):
    df = series(spark, {"a": np.arange(50) + 1.0, "b": np.arange(7) + 1.0})
    out = win.over_past(df, F.col("close"), ["n"], lambda y, first: [y.cumsum()[first:]], rows=8)
    assert {k: v[0] for k, v in by_row(out, "n").items()} == {(s, t): (t + 1) * (t + 2) / 2 for s, n in (("a", 50), ("b", 7)) for t in range(n)}


def test_csw_kernel_with_gaps_and_chunks():
    y = np.random.default_rng(2).normal(size=900).cumsum()
    y[[0, 5, 300, 301]] = np.nan
    y[512:768] = np.nan
    for two_sided in (False, True):
        whole = K.csw(y, two_sided=two_sided)
        for first in (1, 255, 600, 899):
            np.testing.assert_array_equal(np.array(K.csw(y, first, two_sided=two_sided)), np.array(whole)[:, first:])
        square = np.diff(y) ** 2
        square = np.nansum(square) / ((~np.isnan(square)).sum() - 1)
        for t in (899, 800):
            rise = (y[t] - y[:t]) / np.sqrt(t - np.arange(t))
            before = np.diff(y[: t + 1]) ** 2
            assert whole[0][t] == pytest.approx(np.nanmax(np.abs(rise) if two_sided else rise) / (np.nansum(before) / ((~np.isnan(before)).sum() - 1)), nan_ok=True)
        assert whole[0][899] == pytest.approx(np.nanmax((np.abs(y[899] - y[:899]) if two_sided else y[899] - y[:899]) / np.sqrt(899 - np.arange(899))) / square)
    assert np.isnan(whole[0][300])


@pytest.mark.parametrize(("lags", "constant", "trend"), [(0, False, False), (0, True, False), (2, True, False), (3, True, True)])
def test_sadf_ends_are_the_largest_over_all_starts(lags, constant, trend):
    y = np.log(np.random.default_rng(4).normal(size=130).cumsum() + 60)
    y[20:45] = y[20]  # windows of equal values have singular products
    y[7] = np.nan
    least, whole = lags + 9, K.sadf_ends(y, 0, lags + 9, lags, constant, trend)
    np.testing.assert_array_equal(K.sadf_ends(y, 77, least, lags, constant, trend), whole[77:])
    assert np.isnan(whole[7])
    for e in (least, 60, 100, 129):
        past = y[: e + 1][~np.isnan(y[: e + 1])]
        assert whole[e] == pytest.approx(K.sadf(past, least, lags, constant, trend), rel=1e-6)


def test_sadf_starts_from_the_beginning(spark):
    r = np.random.default_rng(6)
    values = {"boom": 1.02 ** np.arange(150) + r.normal(0, 0.01, 150), "walk": r.normal(size=150).cumsum() + 90}
    df = series(spark, values)
    plain, cut, events = by_row(R.sadf_sequence(df), "sadf"), by_row(R.sadf_sequence(df, 60), "sadf"), by_row(R.sadf_events(df, every=2), "sadf_log_tstat", "sadf_log_break")
    for s, close in values.items():
        for t in (11, 70, 149):
            assert plain[s, t][0] == pytest.approx(K.sadf(close[: t + 1], 12), rel=1e-6)
        for t in (66, 100, 149):
            want = K.sadf(np.log(close[: t + 1 : 2]), 34, 3, constant=True, trend=True)
            assert events[s, t] == [pytest.approx(want, rel=1e-6), int(want > -2.86)]
    assert plain["boom", 10] == [None] and plain["boom", 149][0] > cut["boom", 149][0]


@pytest.mark.parametrize("lags, constant, trend", [(0, False, False), (0, True, False), (2, True, True), (3, True, True)])
def test_sadf_by_pairs_of_blocks(spark, lags, constant, trend):
    """Blocks of 16 values, so that most windows have blocks between their ends; one stretch is straight, one value missing."""
    rng = np.random.default_rng(5)
    y = 50 + np.cumsum(rng.normal(size=150))
    y[60:90] = y[60] + 0.5 * np.arange(30)
    values = [None if i == 40 else float(v) for i, v in enumerate(y)]
    rows = [(k, i, v) for k, part in (("long", values), ("short", values[:20]), ("least", values[:3])) for i, v in enumerate(part)]
    df = spark.createDataFrame(rows, "symbol string, i int, close double").withColumn("time", F.timestamp_seconds(F.col("i") * 300))
    got = R.by_block_pairs(df, F.col("close"), "sadf", 12, lags, constant, trend, rows=16)
    assert got.columns == [*df.columns, "sadf"]
    got = got.toPandas().sort_values("i")
    for k, part in (("long", values), ("short", values[:20]), ("least", values[:3])):
        want = K.sadf_ends(np.array([np.nan if v is None else v for v in part]), 0, 12, lags, constant, trend)
        mine = got[got["symbol"] == k]["sadf"].astype(float).to_numpy()
        exact = np.abs(want) > 1e6  # a window without residuals: what is divided by is rounding noise in either form
        assert set(np.flatnonzero(exact)) <= set(range(60, 90)) and (np.abs(mine[exact]) > 1e6).all()
        np.testing.assert_allclose(mine[~exact], want[~exact], rtol=1e-6)
    assert R.by_block_pairs(df.limit(0), F.col("close"), "sadf", 12, lags, constant, trend, rows=16).count() == 0
