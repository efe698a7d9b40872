"""Periodic runs against all pairs of equal words."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import queries
from tidemark.llm import runs as R
from tidemark.llm._common import read

SF = "/root/testdata/sf0.001"


def runs(w, least_words=6, least_periods=4):
    """Longest stretches with period q, for every q; those that a smaller period has as well are that period's."""
    out, taken = [], set()
    for q in range(1, len(w) // 2 + 1):
        same, i = [a == b for a, b in zip(w, w[q:])] + [False], 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j > i:
                span = (i, j + q - i)
                if span[1] >= max(least_words, least_periods * q) and span not in taken and not inner(w[i : j + q], q):
                    out.append((*span, q))
                    taken.add(span)
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def inner(w, q):
    return any(w[d:] == w[:-d] for d in range(1, q))


def damaged(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = damaged(doc_id, brute.WORD.findall(text or ""))
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % x for x in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def columns(df):
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert df.columns == ["doc_id", *names]
    return [(r["doc_id"], *(r[c] for c in names)) for r in df.collect()]


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    got = columns(queries.QUERIES["op13_periodic_runs"](spark, SF))
    assert sorted(got) == sorted((i, *expected(i, t)) for i, t in docs)
    assert sum(x[1] > 0 for x in got) > 5


def test_nulls_repeats_and_other_columns(spark):
    loop = "x y z " * 9
    rows = [(None, "a " * 9), (1, loop), (1, loop), (2, None), (3, ""), (4, " \t\n"), (5, "aaaaaaaa aaaaaaaab " * 4), (6, "a b a b a b a b c"), (None, None), (7, "é é é é é é e"), (8, "w" * 100_000 + " v")]
    df = spark.createDataFrame([(*r, 7, "r") for r in rows], "doc_id long, text string, runs int, collapsed string")
    found = R.periodic_runs(df).collect()
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=repr)
    want = []
    for i, t in rows:
        w = brute.WORD.findall(t or "")
        gone = {k for s, n, q in runs(w) for k in range(s + q, s + n)}
        want.append((i, runs(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert R.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="least_periods"):
        R.periodic_runs(df, least_periods=2)


def test_edges_and_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(600):
        letters = rng.choice([1, 2, 2, 3, 4])
        w = [rng.randint(1, letters) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.6:
            w = (w[: rng.randint(0, 5)] + [rng.randint(1, letters) for _ in range(rng.randint(1, 6))] * rng.randint(2, 9) + w)[: rng.randint(1, 70)]
        text = [*w, -1]
        after, common = R.lyndon_edges(array("i", text))
        for i, x in enumerate(after):
            want = next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text))
            assert x == want and text[i : i + common[i]] == text[x : x + common[i]]
        for least in ((6, 4), (2, 3)):
            found = R.find_runs(np.array(w), np.zeros(len(w), np.int64), 1, *least)
            assert list(zip(*(x.tolist() for x in found), strict=True)) == runs(w, *least)


def test_comparisons_stay_linear():
    class Counted(array):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return array.__getitem__(self, i)

    n, rng = 4000, random.Random(1)
    fibonacci = [[1], [2]]
    while len(fibonacci[-1]) < n:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    block = [rng.randint(1, 3) for _ in range(100)]
    for w in ([1] * n, [1, 2] * (n // 2), fibonacci[-1][:n], block * (n // 100), list(range(1, n)), list(range(n, 0, -1)), [(i & -i).bit_length() for i in range(1, n)]):
        Counted.reads = 0
        R.lyndon_edges(Counted("i", [*w, -1]))
        assert Counted.reads < 11 * n


def test_ranks_are_the_order_of_bytes():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 7, 8, 9, 15, 16, 17, 24, 25]))) for _ in range(500)]
    words += [b"a" * k for k in (8, 16, 24, 40)] + [b"a\0", b"a", b"a" * 8 + b"\0", "ü".encode()]
    data, starts = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
    found = R.ranks(np.frombuffer(data, np.uint8), starts, starts + [len(w) for w in words])
    order = {w: sum(x < w for x in words) for w in words}
    assert found.tolist() == [order[w] for w in words]
