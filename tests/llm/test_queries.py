"""Registered corpus queries at the smallest size, against their SQL where there is one."""

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_mixing import expected
from tidemark.llm import mixing, pieces_codec, queries
from tidemark.llm._common import read

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = db.execute(queries.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, rows.fetchall()))


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for (name, stage), check in zip(corpus_pipeline.STAGES[:3], (_quality, _exact, _near), strict=True):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        got = {r["doc_id"] for r in docs.collect()}
        assert got == check(rows), name
        rows = {i: t for i, t in rows.items() if i in got}
    last_stages(spark, docs, columns)


def last_stages(spark, docs, columns):
    """Mixing against prefixes taken row by row, encoding against the library."""
    docs = docs.cache()
    rows = [tuple(x) for x in docs.select("doc_id", "text", "lang", "source").collect()]
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    assert mixed.columns == columns
    copies = [c for _, c in expected(rows, mixing.WEIGHTS, corpus_pipeline.SHARE, 1)]
    want = [x for x, c in zip(rows, copies, strict=True) for _ in range(c)]
    got = [tuple(x) for x in mixed.select("doc_id", "text", "lang", "source").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and 0 < len(got) < len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces_codec.MODEL)
    ids = {(i, t): library.encode(t or "") for i, t, _, _ in got}
    encoded = corpus_pipeline.encode(spark, mixed, SF)
    assert encoded.columns == ["doc_id", "ids", "n_pieces", "round_trip"]
    rows = [(x["doc_id"], x["ids"], x["n_pieces"], x["round_trip"]) for x in encoded.collect()]
    assert sorted(rows, key=repr) == sorted(((i, ids[i, t], len(ids[i, t]), True) for i, t, _, _ in got), key=repr)


def test_last_stages_with_null_and_repeated_ids(spark):
    words = "the of and in to is that for it was on as with be by".split()
    rows = [(i // 2 if i % 5 else None, " ".join(words[i % 7 : 3 + i % 13]) if i % 11 else None, ["en", "de", None][i % 3], [f"src{i % 5}", None][i % 8 == 0]) for i in range(90)]
    docs = spark.createDataFrame([(*x, 0, "e", "c") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, copies string")
    last_stages(spark, docs, docs.columns)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == [], name


def _quality(rows):
    out = set()
    for i, t in rows.items():
        m = brute.quality(t)
        if m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"] and m["n_long_repeat_words"] <= 0.15 * m["n_words"] and m["longest_repeat"] <= 60:
            out.add(i)
    return out


def _exact(rows):
    first = {}
    for i in sorted(rows):
        first.setdefault((rows[i] or "").translate(brute.AZ), i)
    return set(first.values())


def _near(rows):
    return {i for i, x in brute.jaccard(list(rows.items())).items() if x[1] == i}
