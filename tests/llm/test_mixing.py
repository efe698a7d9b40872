"""Source mixing against budgets found by bisection and prefixes taken row by row."""

import random
import re
import struct
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import mixing


def level(weights, limits, budget):
    """min(limit, t * weight) of each part for the t at which the parts add up to the budget."""
    weights = [max(w, 0) for w in weights]
    most = sum(x for x, w in zip(limits, weights) if w)
    budget, low, high = min(budget, most), 0.0, 1e12
    for _ in range(300):
        t = (low + high) / 2
        low, high = (t, high) if sum(min(x, t * w) for x, w in zip(limits, weights)) < budget else (low, t)
    return [min(x, high * w) for x, w in zip(limits, weights)]


def budgets(leaves, weights, budget, epochs):
    """leaves: path to tokens."""

    def have(path):
        if any(weights.get(path[:k], 1.0) <= 0 for k in range(1, len(path) + 1)):
            return 0
        inside = {p[len(path)] for p in leaves if p[: len(path)] == path and len(p) > len(path)}
        return sum(have((*path, k)) for k in inside) if inside else epochs * leaves[path]

    out = {}

    def walk(path, budget):
        names = sorted({p[len(path)] for p in leaves if p[: len(path)] == path and len(p) > len(path)})
        if not names:
            out[path] = budget
            return
        for k, b in zip(names, level([weights.get((*path, k), 1.0) for k in names], [have((*path, k)) for k in names], budget), strict=True):
            walk((*path, k), b)

    walk((), min(budget, have(())))
    return out


def order(seed, epoch, id_):
    h = 42
    for v, f in ((seed, "<i"), (epoch, "<i"), (id_, "<q")):
        if v is not None:
            h = xxhash.xxh64(struct.pack(f, v), seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def expected(rows, weights, share, epochs, seed=mixing.SEED):
    """rows: (id, text, lang, source) to (budget, copies) in the order of rows."""
    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    leaf = []
    for _, _, lang, source in rows:
        number = re.search(r"[0-9]{1,9}$", source or "")
        leaf.append((f"domain{int(number.group()) % 4}" if number else "none", lang or "none", source or "none"))
    total = defaultdict(int)
    for p, n in zip(leaf, tokens):
        total[p] += n
    found = budgets(dict(total), weights, share * sum(tokens), epochs)
    out = []
    for (i, *_), p in zip(rows, leaf):
        budget = int(found[p] + 1e-6)
        whole, rest = divmod(budget, total[p]) if total[p] else (0, 0)
        mine = order(seed, whole, i)
        upto = sum(n for (j, *_), q, n in zip(rows, leaf, tokens) if q == p and order(seed, whole, j) <= mine)
        out.append((budget, whole + (rest > 0 and upto <= rest)))
    return out


def documents(n=260):
    r = random.Random(9)
    rows = [(i, " ".join("w" * r.randint(0, 30)), r.choice(["en", "de", None]), r.choice(["src1", "src2", "src6", "src9", "site", None])) for i in range(n)]
    return rows + [(1, "w w", "en", "src1"), (None, "w", "en", "src1"), (None, "w w w", "de", "src2"), (900, None, "fr", "src3"), (901, "", "en", "src1"), (902, "w " * 2000, "it", "src7")]


@pytest.mark.parametrize(("share", "epochs", "weights"), [(0.5, 1, mixing.WEIGHTS), (1.6, 3, mixing.WEIGHTS), (0.9, 2, {("domain1",): 0.0, ("domain2", "de"): 0.0, ("domain2",): 5.0}), (0.3, 1, {})])
def test_budgets_and_prefixes(spark, share, epochs, weights):
    rows = documents()
    # Columns that clash with those that the operator makes or uses inside.
    docs = spark.createDataFrame([(*x, i, "e", "c", "d", 7, "r", "b") for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, place int, epochs string, cut string, domain string, copies int, row string, budget string")
    out = mixing.mixed(docs.repartition(3), share, weights=weights, max_epochs=epochs)
    assert set(out.columns) == {*docs.columns, "leaf_budget"}
    got = {r["place"]: r for r in out.collect()}
    want = expected(rows, weights, share, epochs)
    assert [(got[i]["leaf_budget"], got[i]["copies"]) for i in range(len(rows))] == want
    assert all((r["epochs"], r["cut"], r["row"], r["budget"]) == ("e", "c", "r", "b") for r in got.values())
    mixed = mixing.mix_sources(docs, share, weights=weights, max_epochs=epochs)
    assert mixed.columns == docs.columns
    times = {r["place"]: r["count"] for r in mixed.groupBy("place").count().collect()}
    assert times == {i: c for i, (_, c) in enumerate(want) if c} and mixed.filter("domain <> 'd' OR copies <> 7").count() == 0


def test_weight_of_nothing_leaves_a_source_out(spark):
    docs = spark.createDataFrame([(i, "w w", "en", f"src{i % 4}") for i in range(40)], "doc_id long, text string, lang string, source string")
    kept = mixing.mix_sources(docs, 0.9, weights={("domain0",): 0.0})
    assert {r["source"] for r in kept.select("source").distinct().collect()} == {"src1", "src2", "src3"} and kept.count() == 30


def test_domain_reads_the_column_it_is_given(spark):
    row = spark.createDataFrame([("src7", "src2")], "source string, other string").select(mixing.domain_of(F.col("other")).alias("a"), mixing.domain_of(F.lit("x")).alias("b")).first()
    assert tuple(row) == ("domain2", "none")
