"""Queries over recursions, simulators, streams, models and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import backtest as T
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators import models as ML
from tidemark.operators import recursive as R
from tidemark.operators import splits as V
from tidemark.plans import master
from tidemark.plans.bar_queries import KEYS, OHLCV, O, full, on_bars, rows
from tidemark.plans.label_queries import LABEL_VIEWS, RN, probabilities, sampled
from tidemark.plans.registry import BARS, H1, QUERIES, plain_session, register
from tidemark.sources import bars as B
from tidemark.streaming import streams as ST


def hourly(feature, **options):
    return lambda s, d: feature(B.bars(s, d, "1 hour"), **options)


def by_length(feature, **options):
    """A recursive feature on bars, in chunks where a series is long."""

    def build(s, d):
        df = B.bars(s, d)
        return feature(df, rows=R.chunk_rows(df), **options)

    return build


def numbered(table: str, name: str = "h") -> str:
    before = f"lag(close) OVER ({O})"
    return f"{name} AS MATERIALIZED (SELECT *, row_number() OVER ({O}) AS rn, close - {before} AS ch, close / nullif({before}, 0) - 1 AS r, CASE WHEN {before} IS NOT NULL THEN greatest(high - low, abs(high - {before}), abs(low - {before})) END AS tr, high - lag(high) OVER ({O}) AS up, lag(low) OVER ({O}) - low AS dn FROM {table})"


def by_events(feature, **options):
    """Events along bars, looked for in chunks where a series is long."""

    def build(s, d):
        df = B.bars(s, d)
        return feature(df, rows=R.chunk_rows(df, R.EVENT_ROWS), **options)

    return build


HN = numbered("bars")
H4 = """
bars_h4 AS MATERIALIZED (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS time, arg_max(value, (ts, event_id)) AS close, max(value) AS high, min(value) AS low FROM ticks GROUP BY ALL)"""


def sql_ema(x: str, n: int) -> str:
    a = 2 / (n + 1)
    return f"CASE WHEN a.rn >= {n} THEN sum(CASE WHEN b.rn > {n} THEN {a} * pow({1 - a}, a.rn - b.rn) * b.{x} ELSE pow({1 - a}, a.rn - {n}) * b.{x} / {n} END) END"


def sql_rma(x: str, n: int) -> str:
    w = f"pow({1 - 1 / n}, a.rn - b.rn)"
    return f"CASE WHEN count({x}) >= {n} THEN sum({w} * ({x})) / sum(CASE WHEN ({x}) IS NOT NULL THEN {w} END) END"


def pairs(table: str = "h") -> str:
    return f"FROM {table} a JOIN {table} b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.time, a.rn"


def sql_emas(name: str, table: str, lengths: tuple[int, ...] = (20, 50, 200)) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.symbol, a.time, a.rn, {', '.join(f'{sql_ema("close", n)} AS ema_{n}' for n in lengths)} {pairs(table)})"


_PAIRS = pairs()
EMAS = sql_emas("emas", "h")
register("trend_features", by_length(R.trend), (*KEYS, "ema_algnment"), ("ema_20", "ema_50", "ema_200", "ema_slope_acceleration"), f"""
SELECT symbol, time, coalesce((ema_20 > ema_50 AND ema_50 > ema_200)::INT, 0) - coalesce((ema_20 < ema_50 AND ema_50 < ema_200)::INT, 0) AS ema_algnment, ema_20, ema_50, ema_200, {full("avg(acc)", "acc", 10)} AS ema_slope_acceleration
FROM (SELECT *, ema_20 - 2 * lag(ema_20) OVER ({O}) + lag(ema_20, 2) OVER ({O}) AS acc FROM emas)""", (BARS, HN, EMAS), digits=5)
_HOURS = (BARS, H1, H4, numbered("bars_h1", "n1"), numbered("bars_h4", "n4"), sql_emas("emas1", "n1"), sql_emas("emas4", "n4", (20, 50)))
for legacy in (False, True):
    known = lambda hours: "time" if legacy else f"time + INTERVAL {hours} HOUR"  # noqa: B023, E731
    register("higher_trend" + "_legacy" * legacy, by_length(R.higher_trend, legacy=legacy), (*KEYS, "ema_alignment_h1", "ema_alignment_h4"), ("ema20_h1", "ema50_h1", "ema200_h1", "ema20_h4", "ema50_h4"), f"""
SELECT b.symbol, b.time, coalesce((e.ema_20 > e.ema_50 AND e.ema_50 > e.ema_200)::INT, 0) - coalesce((e.ema_20 < e.ema_50 AND e.ema_50 < e.ema_200)::INT, 0) AS ema_alignment_h1, coalesce((f.ema_20 > f.ema_50)::INT, 0) - coalesce((f.ema_20 < f.ema_50)::INT, 0) AS ema_alignment_h4,
  e.ema_20 AS ema20_h1, e.ema_50 AS ema50_h1, e.ema_200 AS ema200_h1, f.ema_20 AS ema20_h4, f.ema_50 AS ema50_h4
FROM bars b ASOF LEFT JOIN (SELECT *, {known(1)} AS known FROM emas1) e ON b.symbol = e.symbol AND b.time >= e.known ASOF LEFT JOIN (SELECT *, {known(4)} AS known FROM emas4) f ON b.symbol = f.symbol AND b.time >= f.known""", _HOURS, digits=5)
OSC = f"""osc AS MATERIALIZED (SELECT a.symbol, a.time, a.rn, {sql_rma("b.tr", 14)} AS atr_14, {sql_rma("CASE WHEN b.ch > 0 THEN b.ch WHEN b.ch <= 0 THEN 0 END", 14)} AS ups, {sql_rma("CASE WHEN b.ch < 0 THEN b.ch WHEN b.ch >= 0 THEN 0 END", 14)} AS downs,
  {sql_rma("CASE WHEN b.up > b.dn AND b.up > 0 THEN b.up ELSE 0 END", 14)} AS p, {sql_rma("CASE WHEN b.dn > b.up AND b.dn > 0 THEN b.dn ELSE 0 END", 14)} AS m {_PAIRS}),
dxs AS MATERIALIZED (SELECT *, 100 * ups / (ups + abs(downs)) AS rsi_14, CASE WHEN atr_14 IS NOT NULL THEN 100 * abs(p - m) / nullif(p + m, 0) END AS dx FROM osc)"""
register("oscillators", by_length(R.oscillators), (*KEYS, "momentum_regime"), ("atr_14", "rsi_14", "adx_14", "vol_expansion_rate"), f"""
SELECT o.symbol, o.time, atr_14, rsi_14, adx_14, vol_expansion_rate, CASE WHEN rm > 0.5 THEN 1 WHEN rm < -0.5 THEN -1 ELSE 0 END AS momentum_regime
FROM (SELECT *, {full("avg(da)", "da", 10)} AS vol_expansion_rate, {full("avg(dr)", "dr", 10)} AS rm FROM (SELECT *, atr_14 - lag(atr_14) OVER ({O}) AS da, rsi_14 - lag(rsi_14) OVER ({O}) AS dr FROM dxs)) o
JOIN (SELECT a.symbol, a.time, {sql_rma("b.dx", 14)} AS adx_14 FROM dxs a JOIN dxs b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.time) x ON o.symbol = x.symbol AND o.time = x.time""", (BARS, HN, OSC), digits=5)
register("target_volatility", on_bars(R.target_volatility), KEYS, ("target_vol",), "SELECT a.symbol, a.time, sum(CASE WHEN b.rn = 1 THEN pow(0.99, a.rn - 1) ELSE 0.01 * pow(0.99, a.rn - b.rn) END * coalesce(b.tr, b.high - b.low)) AS target_vol " + _PAIRS, (BARS, HN), digits=5)
register("daily_volatility", lambda s, d: R.daily_volatility(L.daily_change(B.bars(s, d))), KEYS, ("daily_vol",))
Z = f"z AS MATERIALIZED (SELECT symbol, time, row_number() OVER ({O}) AS rn, q / nullif(CASE WHEN count(q) OVER {rows(288)} >= 72 THEN stddev_pop(q) OVER {rows(288)} END, 0) AS z FROM (SELECT *, coalesce(r, 0) AS q FROM h))"
CUSUM = """steps(symbol, rn, up, dn, hit) AS (
  SELECT DISTINCT symbol, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM z
  UNION ALL SELECT symbol, rn, CASE WHEN hit THEN 0 ELSE up END, CASE WHEN hit THEN 0 ELSE dn END, hit::INT FROM (
    SELECT symbol, rn, up, dn, up > 5 OR dn < -5 AS hit FROM (SELECT z.symbol, z.rn, CASE WHEN z.z IS NULL THEN 0 ELSE greatest(0, s.up + z.z) END AS up, CASE WHEN z.z IS NULL THEN 0 ELSE least(0, s.dn + z.z) END AS dn FROM steps s JOIN z ON z.symbol = s.symbol AND z.rn = s.rn + 1)))"""
_CUSUM = "SELECT z.symbol, z.time, s.hit::TINYINT AS cusum_event FROM z JOIN steps s USING (symbol, rn)"
register("cusum_events", by_events(R.cusum_events), (*KEYS, "cusum_event"), (), _CUSUM, (BARS, HN, Z, CUSUM))
register("cusum_events_chunks", on_bars(R.cusum_events, rows=700), (*KEYS, "cusum_event"), (), _CUSUM, (BARS, HN, Z, CUSUM))


def sql_filter(frame: str) -> str:
    """The symmetric filter row by row; frame: over which rows the mean of the deviation is taken."""
    return f"""limits AS MATERIALIZED (SELECT symbol, time, rn, lr, coalesce(2 * avg(dev) OVER ({frame}), 0.001) AS h FROM (SELECT symbol, time, rn, ln(nullif(close, 0)) - ln(nullif(lag(close) OVER ({O}), 0)) AS lr, {full("stddev_samp(r)", "r", 288)} AS dev FROM h)),
moves(symbol, rn, up, dn, hit) AS (
  SELECT DISTINCT symbol, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM limits
  UNION ALL SELECT symbol, rn, CASE WHEN known AND dn >= -h AND up > h THEN 0 ELSE up END, CASE WHEN known AND dn < -h THEN 0 ELSE dn END, (known AND (dn < -h OR up > h))::INT FROM (
    SELECT l.symbol, l.rn, l.h, l.lr IS NOT NULL AS known, CASE WHEN l.lr IS NULL THEN m.up ELSE greatest(0, m.up + l.lr) END AS up, CASE WHEN l.lr IS NULL THEN m.dn ELSE least(0, m.dn + l.lr) END AS dn FROM moves m JOIN limits l ON l.symbol = m.symbol AND l.rn = m.rn + 1))"""


_FILTER = "SELECT l.symbol, l.time, m.hit::TINYINT AS filter_event FROM limits l JOIN moves m USING (symbol, rn)"
_SO_FAR = f"{O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
register("filter_events", by_events(R.filter_events), (*KEYS, "filter_event"), (), _FILTER, (BARS, HN, sql_filter(_SO_FAR)))
register("filter_events_chunks", on_bars(R.filter_events, rows=700), (*KEYS, "filter_event"), (), _FILTER, (BARS, HN, sql_filter(_SO_FAR)))
register("filter_events_legacy", by_events(R.filter_events, legacy=True), (*KEYS, "filter_event"), (), _FILTER, (BARS, HN, sql_filter("PARTITION BY symbol")))
_BINS = lambda n: f"list_transform(range({n}), lambda i: len(list_filter(xs, lambda x: CASE WHEN mx > mn THEN least(floor((x - mn) / (mx - mn) * {n}), {n - 1}) ELSE {n // 2} END = i)) / len(xs))"
_LISTS = lambda n: f"(SELECT *, list_min(xs) AS mn, list_max(xs) AS mx FROM (SELECT symbol, time, list(r) FILTER (r IS NOT NULL) OVER {rows(n)} AS xs FROM h))"
_RANGE = lambda n: f"SELECT symbol, time, CASE WHEN len(xs) >= {n // 4} THEN -list_sum(list_transform(list_filter({_BINS(9)}, lambda p: p > 0), lambda p: p * log2(p))) END AS price_range_entropy_w{n} FROM {_LISTS(n)}"
register("range_entropy", on_bars(lambda df: R.range_entropy(R.range_entropy(df), 288)), KEYS, ("price_range_entropy_w144", "price_range_entropy_w288"), f"SELECT * FROM ({_RANGE(144)}) JOIN ({_RANGE(288)}) USING (symbol, time)", (BARS, HN))
register("renyi_entropies", on_bars(lambda df: R.renyi_entropies(df).withColumnsRenamed({"renyi_entropy_q0.5": "half", "renyi_entropy_q2.0": "two"})), KEYS, ("half", "two"), f"SELECT symbol, time, CASE WHEN len(xs) >= 144 THEN ln(list_sum(list_transform(ps, lambda p: sqrt(p)))) / 0.5 END AS half, CASE WHEN len(xs) >= 144 THEN -ln(list_sum(list_transform(ps, lambda p: p * p))) END AS two FROM (SELECT *, {_BINS(10)} AS ps FROM {_LISTS(144)})", (BARS, HN))
register("complexity", on_bars(R.complexity), KEYS, ("apen_w100", "sampen_w100", "lz76_w100"))
register("sadf_events", on_bars(R.sadf_events), (*KEYS, "sadf_log_break"), ("sadf_log_tstat", "sadf_log_crit"))
register("sadf_advanced", on_bars(R.sadf_advanced), (*KEYS, "sadf_log_break"), ("sadf_log_tstat", "sadf_log_crit", "sadf_normalized"), digits=5)
register("sadf_sequence", on_bars(R.sadf_sequence), KEYS, ("sadf",), """
SELECT h.symbol, h.time, max(t) AS sadf FROM h LEFT JOIN (
  SELECT symbol, rn, xy / xx / sqrt(nullif(greatest(yy - xy * xy / xx, 0), 0) / (n - 1) / xx) AS t FROM (
    SELECT e.symbol, e.rn, e.rn - s.rn AS n, e.xy - s.xy AS xy, nullif(e.xx - s.xx, 0) AS xx, e.yy - s.yy AS yy FROM sums e JOIN sums s ON e.symbol = s.symbol AND s.rn <= e.rn - 11)) x ON h.symbol = x.symbol AND h.rn = x.rn GROUP BY ALL""", (BARS, HN, f"sums AS MATERIALIZED (SELECT symbol, rn, sum(coalesce((close - ch) * ch, 0)) OVER ({O}) AS xy, sum(coalesce(pow(close - ch, 2), 0)) OVER ({O}) AS xx, sum(coalesce(ch * ch, 0)) OVER ({O}) AS yy FROM h)"), digits=5)

# simulators ---------------------------------------------------------------------------------------------------------
SIM = ("symbol", "time", "side")
SIM_D = ("equity", "position", "pnl")
register("backtest_crossover", hourly(lambda df: T.event_backtest(T.crossover_signals(R.emas(df, (10, 30)), "ema_10", "ema_30"))), SIM, SIM_D, digits=4)
register("backtest_precomputed", on_bars(lambda df: T.event_backtest(T.hold_signals(probabilities(df).withColumnsRenamed({"p0": "long_label", "p1": "short_label"}), 0.42, 0.265, 12))), SIM, SIM_D, digits=4)
register("backtest_model_signal", on_bars(lambda df: T.event_backtest(T.hold_signals(probabilities(df).withColumnRenamed("p0", "long_label"), 0.42, None, 12))), SIM, SIM_D, digits=4)
register("backtest_atr", on_bars(lambda df: T.atr_backtest(probabilities(R.target_volatility(df)).withColumnRenamed("target_vol", "atr").withColumn("win_prob", F.col("p0")).withColumn("side", F.when(F.col("close") > F.col("open"), 1).otherwise(-1)), 0.4, 2.0, 4.0, 0.05)), SIM, SIM_D, digits=4)
register("backtest_fixed_hold", on_bars(lambda df: T.fixed_hold_backtest(probabilities(df).withColumn("win_prob", F.col("p0")), 0.4)), SIM, SIM_D, digits=4)

# streams ------------------------------------------------------------------------------------------------------------
register("stream_bars", lambda s, d: ST.streamed_bars(ST.tick_stream(s, d)), KEYS, OHLCV, "SELECT * FROM bars")
register("stream_distinct", lambda s, d: ST.streamed_distinct(ST.tick_stream(s, d).unionAll(ST.tick_stream(s, d))), ("symbol", "event_id"), ("value",), "SELECT symbol, event_id, value FROM ticks")
register("stream_ema", lambda s, d: ST.streamed_ema(ST.tick_stream(s, d)), ("symbol", "event_id"), ("ema",))
register("stream_cusum", lambda s, d: ST.streamed_cusum(ST.tick_stream(s, d), 300.0, 50.0), ("symbol", "event_id", "event"))

# models -------------------------------------------------------------------------------------------------------------
#: Features of the registered models. Boosted ones take fewer rounds than the operators' own settings; see the README.
FEATURES = ("log_ret", "spread_proxy", "volume", "volume_roc", "volume_abnormality", "obv_slope", "volume_regime", "hour_of_day", "day_of_week", "is_london_session", "is_ny_session", "session_transition", "ema_20", "ema_50", "ema_algnment", "ema_slope_acceleration", "atr_14", "rsi_14", "adx_14", "vol_expansion_rate", "momentum_regime", "returns_skew_rolling", "returns_kurt_rolling", "var_breach", "volatility_regime", "volatility_stress", "fractal_dim_14", "fractal_dim_30", "shannon_entropy_sign_w144", "sign_change_rate_w144", "max_drawdown_w288", "max_drawup_w288")
FEW = {"maxIter": 20}


def model_rows(s, d):
    """Features of five-minute bars (0 where unknown), whether the next bar rises, and the class of each."""
    df = R.oscillators(R.trend(W.row_numbers(B.bars(s, d)), None), None)
    df = X.volatility_stress(X.volatility_regime(X.distribution(X.returns(X.sessions(X.microstructure(df.drop("rn")))))))
    df = X.excursions(X.sign_entropy(X.fractal_dimension(df, (14, 30))), 288, 72)
    rows = sampled(df).withColumn("up", (F.lead("close").over(L.order()) > F.col("close")).cast("double")).withColumn("code", F.col("label") + 1.0)
    path = ST.work_folder(s, "model-rows")  # written once, as every fit reads it many times
    V.folds(rows.dropna("any", subset=["up"]).fillna(0.0, subset=list(FEATURES)), 3).write.parquet(path)
    return s.read.parquet(path)


def on_models(use):
    return lambda s, d: use(model_rows(s, d))


register("model_out_of_fold", on_models(lambda df: ML.positive_probability(ML.out_of_fold(df, V.expanding(df, 2), ML.binary_model(FEATURES, "up", "fast", **FEW))).withColumn("split", F.col("split").cast("int"))), (*KEYS, "split"), ("win_prob",))
register("model_multiclass", on_models(lambda df: ML.multiclass_model(FEATURES, "code").fit(df).transform(df)), KEYS, ("prediction",))
register("model_importances", on_models(lambda df: ML.mean_importance(df.sparkSession.createDataFrame([(k, f, v) for k in ("fast", "balanced") for f, v in ML.importances(ML.binary_model(FEATURES, "up", k, **FEW).fit(df), FEATURES)], "model string, feature string, importance double"))), ("feature",), ("importance",))
register("model_search", on_models(lambda df: ML.search(df, V.expanding(df, 2), FEATURES, "code", 3, space={"trees": [50, 100], "depth": [3, 5, 8]})), ("trial", "trees", "depth", "split"), ("accuracy",))

register("model_persisted", on_models(lambda df: ML.positive_probability(ML.saved(ML.binary_model(FEATURES, "up", "fast", **FEW).fit(df), ST.work_folder(df.sparkSession, "model")).transform(df))), KEYS, ("win_prob",))
register("model_per_label", on_models(lambda df: ML.positive_probability(ML.fit_labels(df.withColumn("never", F.lit(0.0)), FEATURES, ("up", "never"), **FEW)["up"].transform(df))), KEYS, ("win_prob",))
register("model_size", on_models(lambda df: ML.size_model(FEATURES, "ret", **FEW).fit(df.filter("ret IS NOT NULL")).transform(df)), KEYS, ("prediction",))
register("model_one_vs_rest", on_models(lambda df: ML.one_vs_rest_model(FEATURES, "code").fit(df).transform(df)), KEYS, ("prediction",))
register("scaled_features", on_models(lambda df: ML.scaled(FEATURES[:3], ("symbol",)).fit(df).transform(df).withColumn("_v", ML.vector_to_array("scaled")).select(*KEYS, *(F.get("_v", F.lit(i)).alias(c) for i, c in enumerate(FEATURES[:3])))), KEYS, FEATURES[:3])

# whole pipeline -----------------------------------------------------------------------------------------------------


def master_features(s, d):
    bars = B.bars(s, d)
    df = master.all_features(bars, work=ST.work_folder(s, "features"))
    return df.select(*KEYS, *(F.col(f"`{c}`").cast("double").alias(c.replace(".", "_").replace("-", "m")) for c in master.feature_names(df, bars)))


def all_master_features(s, d):
    """Every feature, so that none is left out of the plan."""
    plain_session(s)
    df = master_features(s, d)
    return df.select("symbol", F.col("time").cast("timestamp_ntz").alias("time"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in df.columns[2:]))


QUERIES["master_features"] = all_master_features
register("data_set", lambda s, d: master.data_set(B.bars(s, d), work=ST.work_folder(s, "data-set")), (*KEYS, "t1", "side", "bin"), ("trgt", "ret", "volume_roc"), f"""
SELECT symbol, time, e.t AS t1, side, CASE WHEN side < 0 THEN -sign(e.m)::INT ELSE e.k END AS bin, trgt, e.m AS ret, volume_roc FROM timed_labels JOIN (SELECT symbol, time, 100 * (volume / nullif(lag(volume, 14) OVER ({O}), 0) - 1) AS volume_roc FROM bars) USING (symbol, time) WHERE e IS NOT NULL""", LABEL_VIEWS)
