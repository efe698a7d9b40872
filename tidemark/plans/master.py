"""The whole feature pipeline and the labelled data set built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import row_numbers
from tidemark.operators import align
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import recursive as R

#: Columns that are constants by design: their sources are not in bars.
CONSTANTS = {"vix_regime": 0, "put_call_ratio": 0, "commitment_traders": 0, "sentiment_extremes": 0, "macd_divergence": 0, "rsi_divergence": 0}
WINDOWS, BREAKS = (144, 288), (288, 1440)


def all_features(bars: DataFrame, windows=WINDOWS, breaks=BREAKS, legacy: bool = False, complete: bool = False, work: str | None = None, rows: int = R.ROWS, event_rows: int = R.EVENT_ROWS) -> DataFrame:
    """Bars with every feature family. complete: only rows where all features that bars can fill are known (optional
    columns such as spread do not count). work: a new folder in which stages in between are written, which keeps the plan
    of each short and survives lost executors; with it, exponential means of series over `rows` rows, and events of those
    over `event_rows`, are found in chunks of so many. Without it each series is one task there, as chunks read what
    comes before them twice."""

    def stage(df: DataFrame, name: str, wanted: bool = True) -> DataFrame:
        if work is None or not wanted:
            return df
        df.write.parquet(f"{work}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

    # What reads the bars twice comes first, so that no long plan is repeated; rows are numbered once for all kernels.
    df = stage(row_numbers(bars), "numbered")
    means, events = (None if work is None else R.chunk_rows(df, n) for n in (rows, event_rows))
    df = stage(R.sadf_events(R.higher_trend(df, legacy, means)), "joined")
    df = stage(R.trend(X.microstructure(X.sessions(df)), means), "trend", means is not None)
    df = stage(R.oscillators(df, means), "oscillators", means is not None)
    df = X.distribution(df).withColumns({k: F.lit(v) for k, v in CONSTANTS.items()})
    for n in windows:
        df = R.range_entropy(X.sign_entropy(df, n), n)
    df = X.volatility_stress(X.volatility_regime(X.fractal_dimension(df)))
    df = stage(df, "before-events", events is not None)
    df = stage(X.z_score_event(R.filter_events(df, windows[-1], legacy=legacy, rows=events), windows[-1]), "filtered", events is not None)
    df = stage(R.cusum_events(df, rows=events), "events")
    for n in breaks:
        df = X.excursions(X.one_sided_deviation(df, n), n, max(8, n // 4)).drop(f"sub_martingale_z_w{n}", f"super_martingale_z_w{n}")
        df = df.withColumn(f"cusum_event_rate_w{n}", X.mean(F.col("cusum_event"), n, max(8, n // 4)))
        df = X.run_length_since(df, "cusum_event", f"time_since_last_event_w{n}")
    df = X.power_means(R.renyi_entropies(df, windows[0]), windows[0])  # last, as grouped operators take no names with dots
    df = df.drop("rn")
    return df.dropna("any", subset=[f"`{c}`" for c in feature_names(df, bars)]) if complete else df


def feature_names(df: DataFrame, bars: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in bars.columns]


#: Settings of the published versions of the data set that differ: the target's multiple and the bars between events.
VERSIONS = {1: {"pt": 15.0, "every": 12}, 2: {"pt": 20.0, "every": 12}, 3: {"pt": 20.0, "every": 1}}


def labelled(bars: DataFrame, window: int = 288, every: int = 12, quantile: float = 0.8, pt: float = 15.0, sl: float = 1.5, wait: str = "INTERVAL 5 DAYS", lookback: int = 50) -> DataFrame:
    """Strong trends as events with barrier labels: (symbol, time, t1, side, trgt, ret, bin), short ones recoded. Trades last to
    the first bar at or after `wait`; where the series ends before, only those that touch a barrier are labelled."""
    events = L.strong_trends(L.trend_scan(bars, window, every=every), quantile).select("symbol", "time", "side")
    vol = R.daily_volatility(L.daily_change(bars).select("symbol", "time", "day_ret"), lookback).select("symbol", "time", F.col("daily_vol").alias("trgt"))
    ends = L.vertical_barrier(events.select("symbol", "time"), bars, wait)
    rows = bars.join(vol, ["symbol", "time"]).join(events, ["symbol", "time"], "left").join(ends, ["symbol", "time"], "left")
    marked = L.barrier_labels_by_time(rows, pt, sl, "vertical", F.col("side").isNotNull())
    return L.short_recode(marked).select("symbol", "time", "t1", "side", "trgt", "ret", "bin")


def data_set(bars: DataFrame, version: int = 1, work: str | None = None, complete: bool = False, **options) -> DataFrame:
    """All features and the labels of the same bars, by symbol and time. Options are those of labelled(); work and complete
    are those of all_features()."""
    labels = labelled(bars, **(VERSIONS[version] | options))
    features = all_features(bars, work=work, complete=complete)
    features = features.drop(*(c for c in labels.columns if c in features.columns and c not in ("symbol", "time")))
    return align.common_rows(features, labels).join(labels, ["symbol", "time"])
