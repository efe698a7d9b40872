"""Models over feature frames with pyspark.ml: fits, folds, search, importances."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from statistics import NormalDist

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Three tree ensembles for one label: quick, deep, and between.
BINARY = {
    "fast": {"maxIter": 100, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8},
    "deep": {"maxIter": 500, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.7},
    "balanced": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.075, "subsamplingRate": 0.75},
}
#: Ensembles of the second models: for classes, and for a size.
CLASSES = {"numTrees": 200, "maxDepth": 5, "subsamplingRate": 0.8}
SIZES = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8}

#: A part of a search space: choices, or (low, high, kind) with the kinds int, float and log (even in the logarithm).
Space = list | tuple[float, float, str]
FORESTS: dict[str, Space] = {"trees": [100, 200, 300, 500], "depth": [3, 4, 5, 6, 7, 8]}

# The published search spaces of boosted trees.
_WIDE = {"n_estimators": (100, 1000, "int"), "max_depth": (3, 10, "int"), "learning_rate": (0.01, 0.3, "log"), "subsample": (0.6, 1.0, "float"), "colsample_bytree": (0.6, 1.0, "float"), "gamma": (0.0, 5.0, "float")}
_NARROW = {"n_estimators": (100, 1000, "int"), "max_depth": (3, 8, "int"), "learning_rate": (0.01, 0.2, "float"), "subsample": (0.7, 1.0, "float"), "colsample_bytree": (0.7, 1.0, "float"), "gamma": (0.0, 2.0, "float"), "reg_alpha": (0.0, 1.0, "float"), "reg_lambda": (0.0, 1.0, "float")}
_PENALTIES = {"min_child_weight": (1, 10, "int"), "reg_alpha": (1e-8, 2.0, "log"), "reg_lambda": (1e-8, 2.0, "log")}
_COLUMNS = {"colsample_bylevel": (0.6, 1.0, "float"), "colsample_bynode": (0.6, 1.0, "float")}
#: Spaces by version.
SPACES: dict[str, dict[str, Space]] = {
    "single": _WIDE,
    "v1": _NARROW,
    "v1_short": _NARROW | {"n_estimators": (50, 300, "int")},
    "v2": _WIDE | _COLUMNS | _PENALTIES,
    "v3": _WIDE | _COLUMNS | _PENALTIES,
    "v4": _WIDE | _COLUMNS | _PENALTIES,
    "v5": _WIDE | _PENALTIES,
    "v6": _WIDE | _PENALTIES,
}
#: Names of settings here and in pyspark.ml; shares of columns are multiplied, and its trees have no penalties on weights.
TREE_SETTINGS = {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "subsample": "subsamplingRate", "gamma": "minInfoGain", "min_child_weight": "minInstancesPerNode"}


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def binary_model(features: Sequence[str], label: str, kind: str = "fast", seed: int = 42, **changes) -> Pipeline:
    """One of BINARY's ensembles; changes replace its settings."""
    return Pipeline(stages=[assembler(features), GBTClassifier(labelCol=label, seed=seed, **(BINARY[kind] | changes))])


def multiclass_model(features: Sequence[str], label: str, seed: int = 42, **changes) -> Pipeline:
    """label holds codes from 0; changes replace settings of CLASSES."""
    return Pipeline(stages=[assembler(features), RandomForestClassifier(labelCol=label, seed=seed, **(CLASSES | changes))])


def one_vs_rest_model(features: Sequence[str], label: str) -> Pipeline:
    return Pipeline(stages=[assembler(features), OneVsRest(classifier=LogisticRegression(maxIter=20), labelCol=label)])


def size_model(features: Sequence[str], label: str, seed: int = 42, **changes) -> Pipeline:
    """A regression; changes replace settings of SIZES."""
    return Pipeline(stages=[assembler(features), GBTRegressor(labelCol=label, seed=seed, **(SIZES | changes))])


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """The model as it is read back from where it is kept."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def scaled(features: Sequence[str], categories: Sequence[str] = ()) -> Pipeline:
    """Standard scores of features and one-hot codes of categories, to be fitted on training rows only."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="scaled", withMean=True)]
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index"), OneHotEncoder(inputCols=[f"{c}_index"], outputCols=[f"{c}_code"])]
    return Pipeline(stages=stages)


def fit_labels(df: DataFrame, features: Sequence[str], labels: Sequence[str], kind: str = "fast", **changes) -> dict[str, PipelineModel]:
    """One model per 0/1 label; labels with a single class are skipped. One pass finds the classes."""
    seen = df.agg(*(F.countDistinct(c).alias(c) for c in labels)).first()
    return {c: binary_model(features, c, kind, **changes).fit(df) for c in labels if seen[c] > 1}


def positive_probability(scored: DataFrame, name: str = "win_prob") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1])


def out_of_fold(df: DataFrame, splits: DataFrame, model: Pipeline, key: Sequence[str] = ("symbol", "row")) -> DataFrame:
    """Predictions for the test rows of each split by a model fitted on its training rows (split, role and key in splits)."""
    out = None
    for (split,) in sorted(splits.select("split").distinct().collect()):
        mine = splits.filter(F.col("split") == split)
        part = lambda role: df.join(mine.filter(F.col("role") == role).select(*key), list(key), "left_semi")  # noqa: B023, E731
        scored = model.fit(part("train")).transform(part("test")).withColumn("split", F.lit(split))
        out = scored if out is None else out.unionByName(scored)
    return out


def draw(space: Mapping[str, Space], rng: random.Random) -> dict[str, float | int]:
    """Settings drawn evenly from a space."""
    return {name: _value(part, rng.random()) for name, part in space.items()}


def _value(part: Space, u: float) -> float | int:
    """What lies at the share u of a part of a space."""
    if isinstance(part, list):
        return part[min(int(u * len(part)), len(part) - 1)]
    low, high, kind = part
    if kind == "log":
        return min(max(math.exp(math.log(low) + u * (math.log(high) - math.log(low))), low), high)
    return min(low + int(u * (high - low + 1)), high) if kind == "int" else low + u * (high - low)


def _place(part: Space, value: float) -> float:
    """The share at which a value lies; that of a choice or whole number is the middle of its share."""
    if isinstance(part, list):
        return (part.index(value) + 0.5) / len(part)
    low, high, kind = part
    if kind == "log":
        return (math.log(value) - math.log(low)) / (math.log(high) - math.log(low))
    return (value - low + 0.5) / (high - low + 1) if kind == "int" else (value - low) / (high - low)


class _Density:
    """Density of shares near some trials: a bell around each, as wide as the gap to its farther neighbour, and one even part,
    so that nothing is ruled out. For choices, how often each was taken, and once more."""

    def __init__(self, part: Space, places: Sequence[float]):
        self.choices = len(part) if isinstance(part, list) else 0
        if self.choices:
            self.weights = [1.0] * self.choices
            for u in places:
                self.weights[int(u * self.choices)] += 1
            return
        edges = [0.0, *sorted(places), 1.0]
        least = 1 / min(100, len(places) + 1)
        self.bells = [(m, max(m - edges[i], edges[i + 2] - m, least)) for i, m in enumerate(edges[1:-1])]

    def take(self, rng: random.Random) -> float:
        if self.choices:
            return (rng.choices(range(self.choices), self.weights)[0] + 0.5) / self.choices
        at = rng.randrange(len(self.bells) + 1)
        if at == len(self.bells):
            return rng.random()
        middle, width = self.bells[at]
        while True:
            u = rng.gauss(middle, width)
            if 0 <= u <= 1:
                return u

    def at(self, u: float) -> float:
        if self.choices:
            return self.weights[min(int(u * self.choices), self.choices - 1)] / sum(self.weights)
        total = 1.0
        for middle, width in self.bells:
            inside = NormalDist(middle, width).cdf(1) - NormalDist(middle, width).cdf(0)
            total += NormalDist(middle, width).pdf(u) / inside
        return total / (len(self.bells) + 1)


def propose(space: Mapping[str, Space], seen: Sequence[tuple[Mapping[str, float], float]], rng: random.Random, start: int = 10, candidates: int = 24) -> dict[str, float | int]:
    """The next settings to try, given settings and scores (higher is better) of the trials so far.

    The first `start` are drawn evenly. Then the best tenth (25 at most) is told from the rest, and each setting is that of
    `candidates` draws near the good trials which is densest among them against the others.
    """
    if len(seen) < start:
        return draw(space, rng)
    ranked = [s for s, _ in sorted(seen, key=lambda x: -x[1])]
    good = min(-(-len(ranked) // 10), 25)
    out = {}
    for name, part in space.items():
        places = [_place(part, s[name]) for s in ranked]
        near, far = _Density(part, places[:good]), _Density(part, places[good:])
        out[name] = _value(part, max((near.take(rng) for _ in range(candidates)), key=lambda u: near.at(u) / far.at(u)))
    return out


def boosted(features: Sequence[str], label: str, seed: int = 42, classes: int = 2, **settings) -> Pipeline:
    """Boosted trees with settings by their names in SPACES; for more than two classes, one such model for each against the rest."""
    known = {TREE_SETTINGS[k]: v for k, v in settings.items() if k in TREE_SETTINGS}
    share = math.prod(v for k, v in settings.items() if k.startswith("colsample"))
    trees = GBTClassifier(labelCol=label, seed=seed, featureSubsetStrategy="all" if share == 1 else str(share), **known)
    return Pipeline(stages=[assembler(features), trees if classes == 2 else OneVsRest(classifier=trees, labelCol=label)])


def forest(features: Sequence[str], label: str, seed: int = 42, trees: int = 200, depth: int = 5) -> Pipeline:
    return multiclass_model(features, label, seed, numTrees=trees, maxDepth=depth)


def search(df: DataFrame, splits: DataFrame, features: Sequence[str], label: str, trials: int = 100, seed: int = 42, patience: int = 20, tolerance: float = 1e-3, space: Mapping[str, Space] = FORESTS, model: Callable[..., Pipeline] = forest) -> DataFrame:
    """Seeded search over a space: model(features, label, seed, **settings) is tried with settings that propose() draws. One row
    per trial and split with the settings and the accuracy; a trial's score is the mean over splits. Stops when the best
    of the last `patience` trials moves less than `tolerance`."""
    rng, rows, seen, best = random.Random(seed), [], [], []
    for trial in range(trials):
        settings = propose(space, seen, rng)
        scored = out_of_fold(df, splits, model(features, label, seed, **settings))
        found = scored.groupBy("split").agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")).collect()
        rows += [(trial, *settings.values(), int(r["split"]), float(r["accuracy"])) for r in found]
        score = sum(r["accuracy"] for r in found) / len(found)
        seen.append((settings, score))
        best.append(max(score, best[-1] if best else 0))
        if len(best) >= patience and max(best[-patience:]) - min(best[-patience:]) < tolerance:
            break
    kinds = ", ".join(f"`{k}` {'int' if isinstance(_value(p, 0.0), int) else 'double'}" for k, p in space.items())
    return df.sparkSession.createDataFrame(rows, f"trial int, {kinds}, split int, accuracy double")


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by falling importance."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, values, strict=True), key=lambda x: (-x[1], x[0]))


def mean_importance(table: DataFrame, top: int = 15) -> DataFrame:
    """Mean of |importance| over models of (model, feature, importance): the highest `top`."""
    return table.groupBy("feature").agg(F.avg(F.abs("importance")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)
