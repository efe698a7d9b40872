"""MinHash near-dedup against all pairs, and its sketches against rounds taken one by one."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import minhash, queries
from tidemark.llm._common import read

SF = "/root/testdata/sf0.001"


def check(rows, out):
    want = brute.jaccard(rows, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got == {i: x[:2] for i, x in want.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return want


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    df = queries.QUERIES["op12_minhash"](spark, SF)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = check(rows, df.collect())
    assert sum(x[1] != i for i, x in want.items()) > 5


def near_copies():
    """Pairs around the threshold, chains, one large group of near copies, short and empty texts."""
    rng, rows = random.Random(11), []
    word = lambda: f"w{rng.randint(0, 5000)}"
    for n in [*range(1, 12), 30, 60, 120, 400]:
        for changes in (0, 1, 2, 3, n // 20, n // 12):
            base = [word() for _ in range(n)]
            rows.append(" ".join(base))
            for _ in range(changes):
                base[rng.randrange(n)] = word()
            rows.append(" ".join(base))
    chain = [word() for _ in range(100)]
    for _ in range(12):
        rows.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    base = [word() for _ in range(80)]
    for _ in range(70):
        rows.append(" ".join(base[: rng.randint(74, 80)]) + " " + word())
    return [(i, t) for i, t in enumerate([*rows, None, "", " \n", "One", "one", "a b c", "A  B\tc"])]


def test_near_copies(spark):
    rows = near_copies()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, kept int, id string").repartition(7)
    out = minhash.minhash_dedup(df).collect()
    want = check(rows, out)
    assert {r["doc_id"]: r["n_links"] for r in out} == {i: x[2] for i, x in want.items()}
    assert sum(x[2] for x in want.values()) > 1000
    small = minhash.minhash_dedup(df, block=8).collect()  # the large group as pairs of blocks
    assert sorted(map(tuple, small)) == sorted(map(tuple, out))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (3, text), (3, "other words here entirely"), (2, text + " y z"), (None, "alone in the world now"), (3, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.minhash_dedup(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"], r["n_links"]) for r in out), key=repr) == sorted(
        [(None, 57, 2, False, 4), (None, 58, 2, False, 4), (3, 57, 2, False, 4), (3, 57, 2, False, 4), (3, 1, 3, True, 0), (2, 59, 2, True, 4), (None, 2, None, True, 0), (None, 0, None, True, 0)], key=repr
    )
    assert minhash.minhash_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("sizes", [[1, 2, 3, 500], [40], [7] * 30])
def test_sketch_is_that_of_rounds_one_by_one(sizes):
    rng, bins = np.random.default_rng(3), 20
    sets = [rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in sizes]
    got = minhash.sketches(np.concatenate(sets), np.append(0, np.cumsum(sizes)), bins)
    for row, grams in zip(got, sets, strict=True):
        want, i = {}, 0
        while len(want) < bins:
            hashes = minhash.mix(grams + np.uint64((2 * i + 1) * minhash._STEP % (1 << 64)))
            for h in hashes.tolist():
                b = (h >> 32) * bins >> 32 if i < bins else i - bins
                if i < bins or b == i - bins:
                    x = i << 32 | h & 0xFFFFFFFF
                    want[b] = min(want.get(b, x), x)
            i += 1
        assert row.tolist() == [want[b] for b in range(bins)]


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    for n, similarity in ((5, 0.6), (40, 0.8), (400, 0.5), (3000, 0.9)):
        shared = round(n * 2 * similarity / (1 + similarity))
        agree = []
        for _ in range(60):
            pool = rng.integers(1, 1 << 63, 2 * n - shared, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:shared], pool[n:]])
            both = minhash.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            agree.append((both[0] == both[1]).mean())
        true = shared / (2 * n - shared)
        assert abs(np.mean(agree) - true) < 0.02 and np.std(agree) < 1.5 * (true * (1 - true) / minhash.SKETCH) ** 0.5
