"""Every bar query that SQL can express, at the smallest size, against DuckDB."""

import math
import os

import duckdb
import pytest

from tidemark.operators import features as X
from tidemark.plans import registry
from tidemark.sources import bars as B

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    out.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rows = db.execute(registry.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert mine == sorted(repr([plain(v) for v in r]) for r in rows.fetchall())


def same_rows(df, db, name):
    rows = db.execute(registry.SQL[name])
    names = [d[0] for d in rows.description]
    mine = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert mine == sorted(repr([plain(v) for v in r]) for r in rows.fetchall())


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """The smallest tables with closes of 0 far apart, and two of them in a row."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    duckdb.execute(f"""COPY (SELECT event_id, ts, user_id, event_type, CASE WHEN event_type IN ('click', 'view') AND n IN (60, 130, 131) THEN 0.0 ELSE value END AS value, props
      FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM '{SF}/events.parquet')) TO '{folder}/events.parquet'""")
    return folder


@pytest.fixture(scope="module")
def zeros_db(zeros):
    out = duckdb.connect()
    out.execute("SET timezone = 'UTC'")
    out.execute(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet'")
    return out


@pytest.mark.parametrize("name", ["barrier_labels", "binary_meta_label", "short_recode"])
def test_barriers_over_closes_of_zero_against_sql(spark, zeros, zeros_db, name):
    same_rows(registry.QUERIES[name](spark, zeros), zeros_db, name)


@pytest.mark.parametrize("name", ["csw_statistic", "csw_two_sided"])
def test_unknown_references_against_sql(spark, zeros, zeros_db, name):
    same_rows(registry.QUERIES[name](spark, zeros), zeros_db, name)


@pytest.mark.parametrize("two_sided", [False, True])
def test_unknown_references_in_chunks(spark, zeros, two_sided):
    df = B.bars(spark, zeros)
    rows = lambda n: sorted(repr([plain(v) for v in r]) for r in X.csw_statistic(df, two_sided=two_sided, rows=n, strict=True).collect())
    assert rows(4096) == rows(16)


def test_halves_round_as_in_sql(spark):
    values = [-16.4703125, 0.2178125, 0.21781249999999996, 2.5e-6, -7.5e-6, float("inf"), float("nan"), None]
    registry.register("_halves", lambda s, d: s.createDataFrame([(v,) for v in values], "x double"), (), ("x",), "SELECT unnest($1) AS x", ())
    try:
        want = [r[0] for r in duckdb.execute(registry.SQL["_halves"], [values]).fetchall()]
        assert [plain(r["x"]) for r in registry.QUERIES["_halves"](spark, "").collect()] == [plain(v) for v in want]
    finally:
        del registry.QUERIES["_halves"], registry.SQL["_halves"]


OVER_ZERO = "daily_change drop_incomplete encode_returns encode_returns_ranges excursions inner_join_lagged liquidity_features mean_absolute one_sided_deviation power_means returns sign_entropy daily_spread daily_spread_legacy"


@pytest.mark.parametrize("name", OVER_ZERO.split())
def test_division_by_closes_of_zero_against_sql(spark, zeros, zeros_db, name):
    same_rows(registry.QUERIES[name](spark, zeros), zeros_db, name)


def test_excursions_from_and_to_closes_of_zero(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate((2.0, 0.0, 0.0, 0.0, 4.0, 8.0, 5.0))], "symbol string, time int, close double")
    rows = lambda over_zero: [tuple(plain(v) for v in r[3:]) for r in X.excursions(df, 3, over_zero=over_zero).orderBy("time").collect()]
    assert rows(True) == [(None, None)] * 2 + [("nan", "-1"), ("nan", "nan"), ("inf", "0"), ("inf", "0"), ("0.25", "-0.375")]
    assert rows(False) == [(None, None)] * 2 + [(None, "-1"), (None, None), (None, "0"), (None, "0"), ("0.25", "-0.375")]


@pytest.fixture(scope="module")
def equals(tmp_path_factory):
    """The smallest tables with three values only, so that means are often equal."""
    folder = str(tmp_path_factory.mktemp("equals"))
    duckdb.execute(f"COPY (SELECT event_id, ts, user_id, event_type, (1 + event_id % 3) / 10 AS value, props FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    return folder


@pytest.mark.parametrize("name", ["inner_join_lagged", "sma_cross"])
def test_equal_means_against_sql_over_decimals(spark, equals, name):
    """The same SQL, over decimals, adds up without rounding, where over doubles the order of adding decides."""
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * REPLACE (value::DECIMAL(10, 2) AS value) FROM '{equals}/events.parquet'")
    same_rows(registry.QUERIES[name](spark, equals), db, name)


def test_sides_of_equal_unknown_and_infinite_means(spark):
    closes = [0.1, 0.1, 0.1, 0.3, 0.1, 0.2, 0.2, 0.2, 0.2, float("inf"), 0.2, float("nan"), 0.2, 0.2, 0.2, 0.1]
    df = spark.createDataFrame(list(enumerate(closes)), "time int, close double").selectExpr("'s' AS symbol", "*")
    sides = {r["time"]: r["side"] for r in X.sma_cross(df, 2, 3).collect()}
    assert sides == dict(zip(range(3, 16), [1, 1, -1, 1, 1, 1, 1, 1, 1, 1, 1, 1, -1], strict=True))
