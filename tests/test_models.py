"""Models against fits and formulas of the tests' own, the search on known surfaces, and ranks against sorting."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import models as ML
from tidemark.operators import ranks as RK

FEATURES = ("a", "b")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(240):
        a, b = rng.random(), rng.random()
        data.append(("s" if i % 2 else "t", i, a, b, float(a > 0.5), float((a > 0.5) + (b > 0.7)), 3 * a - b))
    return spark.createDataFrame(data, "symbol string, row long, a double, b double, up double, code double, size double").repartition(2, "row").cache()


def values(df, *columns):
    return {r["row"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_out_of_fold_is_a_fit_on_training_rows_only(spark, rows):
    splits = rows.select("symbol", "row", F.explode(F.array(F.lit(0), F.lit(1))).alias("split"))
    splits = splits.withColumn("role", F.when(F.col("row") % 3 == F.col("split"), "test").otherwise("train"))
    model = ML.binary_model(FEATURES, "up", maxIter=3, subsamplingRate=1.0)
    got = ML.positive_probability(ML.out_of_fold(rows, splits, model)).collect()
    assert len(got) == rows.filter("row % 3 < 2").count()
    for split in (0, 1):
        again = ML.positive_probability(model.fit(rows.filter(f"row % 3 <> {split}")).transform(rows.filter(f"row % 3 = {split}")))
        want = values(again, "win_prob")
        mine = {r["row"]: (r["win_prob"],) for r in got if r["split"] == split}
        assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k]) for k in want)
        assert all((p > 0.5) == (k in {r["row"] for r in rows.filter("up = 1").collect()}) for k, (p,) in mine.items())


def test_classes_sizes_and_labels_are_learned(rows):
    assert ML.multiclass_model(FEATURES, "code", numTrees=20, subsamplingRate=1.0).fit(rows).transform(rows).filter("prediction <> code").count() <= 5
    error = ML.size_model(FEATURES, "size", maxIter=20).fit(rows).transform(rows).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("size"), 2)))).first()[0]
    assert error < 0.25 * rows.agg(F.stddev_pop("size")).first()[0]
    found = ML.fit_labels(rows.withColumn("never", F.lit(0.0)), FEATURES, ("up", "never"), maxIter=2, subsamplingRate=1.0)
    # Trees split between 32 bins of a feature, not between rows, so the rows of one bin may lie on the wrong side.
    assert list(found) == ["up"] and found["up"].transform(rows).filter("prediction <> up").count() <= 240 // 32
    names = [f for f, _ in ML.importances(found["up"], FEATURES)]
    assert names[0] == "a" and sum(v for _, v in ML.importances(found["up"], FEATURES)) == pytest.approx(1)


def test_one_vs_rest_takes_the_highest_score(rows):
    model = ML.one_vs_rest_model(FEATURES, "code").fit(rows)
    lines = [(m.coefficients.toArray(), m.intercept) for m in model.stages[-1].models]
    for r in model.transform(rows).collect():
        scores = [c @ np.array([r["a"], r["b"]]) + i for c, i in lines]
        assert r["prediction"] == max(range(len(scores)), key=scores.__getitem__)


def test_mean_importance_by_hand(spark):
    table = spark.createDataFrame([("m", "a", 0.5), ("n", "a", -0.1), ("m", "b", 0.3), ("n", "b", 0.3), ("m", "c", 0.1)], "model string, feature string, importance double")
    assert [(r["feature"], round(r["importance"], 9)) for r in ML.mean_importance(table, 2).collect()] == [("a", 0.3), ("b", 0.3)]


def test_scaled_features_are_standard_scores(rows):
    out = ML.scaled(FEATURES, ("symbol",)).fit(rows).transform(rows).withColumn("v", vector_to_array("scaled")).withColumn("code", vector_to_array("symbol_code")).collect()
    for i, c in enumerate(FEATURES):
        x = [r[c] for r in out]
        for r in out:
            assert r["v"][i] == pytest.approx((r[c] - statistics.mean(x)) / statistics.stdev(x))
    assert {(r["symbol"], tuple(r["code"])) for r in out} in ({("s", (1.0,)), ("t", (0.0,))}, {("s", (0.0,)), ("t", (1.0,))})


# search ---------------------------------------------------------------------------------------------------------------
SURFACE = {"rate": (0.001, 1.0, "log"), "depth": (1, 12, "int"), "share": (0.0, 1.0, "float"), "kind": ["x", "y", "z"]}


def surface(s):
    return -((math.log10(s["rate"]) + 2) ** 2) - ((s["depth"] - 9) / 4) ** 2 - 4 * (s["share"] - 0.2) ** 2 - (s["kind"] != "y")


def best(adaptive: bool, seed: int, trials: int = 60) -> float:
    rng, seen = random.Random(seed), []
    for _ in range(trials):
        s = ML.propose(SURFACE, seen, rng, start=10 if adaptive else trials)
        seen.append((s, surface(s)))
    return max(x for _, x in seen)


def test_search_finds_more_than_even_draws():
    adaptive, even = [best(True, s) for s in range(12)], [best(False, s) for s in range(12)]
    assert statistics.mean(adaptive) > statistics.mean(even) / 2 and sum(a > e for a, e in zip(adaptive, even)) >= 9
    assert best(True, 3) == best(True, 3)


@pytest.mark.parametrize("space", [*ML.SPACES.values(), SURFACE, ML.FORESTS])
def test_settings_stay_in_their_space(space):
    rng, seen = random.Random(1), []
    for i in range(40):
        s = ML.propose(space, seen, rng)
        assert s.keys() == space.keys()
        for k, part in space.items():
            assert s[k] in part if isinstance(part, list) else part[0] <= s[k] <= part[1] and (part[2] != "int" or isinstance(s[k], int))
        seen.append((s, rng.random()))


def test_search_over_splits(spark, rows):
    splits = rows.select("symbol", "row", F.lit(0).alias("split"), F.when(F.col("row") % 3 == 0, "test").otherwise("train").alias("role"))
    space = {"n_estimators": (1, 3, "int"), "max_depth": [1, 2], "learning_rate": (0.05, 0.3, "log"), "colsample_bytree": (0.6, 1.0, "float")}
    out = ML.search(rows, splits, FEATURES, "up", 2, space=space, model=ML.boosted)
    assert out.columns == ["trial", *space, "split", "accuracy"] and out.count() == 2
    classes = ML.boosted(FEATURES, "code", classes=3, n_estimators=2, max_depth=2).fit(rows).transform(rows)
    assert classes.filter("prediction = code").count() > 200


# ranks ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    """A key of distinct values, one with a value that most rows share, one of a single row, and one without values."""
    rng = random.Random(3)
    data = [("even", i, rng.gauss(0, 1)) for i in range(501)] + [("heavy", i, 2.0 if i % 5 else rng.random() * 4) for i in range(400)] + [("one", 0, 7.0), ("none", 0, None), ("even", 501, None)]
    return spark.createDataFrame(data, "symbol string, i long, x double").withColumn("time", F.timestamp_seconds(F.col("i") * 7000))


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_quantiles_and_ranks_against_sorting(mixed, ranges):
    shares = [0.0, 0.25, 0.5, 0.777, 1.0]
    known = {}
    for r in mixed.filter("x IS NOT NULL").collect():
        known.setdefault(r["symbol"], []).append((r["x"], r["time"]))
    got = {r["symbol"]: r["_quantiles"] for r in RK.quantiles(mixed, "symbol", "x", shares, ranges).collect()}
    assert got.keys() == known.keys()
    for k, pairs in known.items():
        np.testing.assert_allclose(got[k], np.quantile([x for x, _ in pairs], shares), rtol=1e-12)
    ranked = RK.ranks(mixed, "symbol", "x", ranges=ranges).withColumn("tile", RK.tile(F.col("_rank"), F.col("_of"), 4)).collect()
    assert len(ranked) == sum(map(len, known.values()))
    for r in ranked:
        assert r["_rank"] == sorted(known[r["symbol"]]).index((r["x"], r["time"])) + 1 and r["_of"] == len(known[r["symbol"]])
        assert r["x"] in np.array_split([x for x, _ in sorted(known[r["symbol"]])], 4)[r["tile"]]
    assert RK.quantiles(mixed.limit(0), "symbol", "x", shares, ranges).count() == 0
