"""Stages of the pipeline on rows whose ids are missing or repeated."""

import corpus_pipeline
from tidemark.llm import jaccard

WORDS = [f"w{i}" for i in range(400)]


def text(k, change=0):
    out = WORDS[40 * k : 40 * k + 40]
    return " ".join(out[:-change] + ["other"] * change if change else out)


def kept(spark, stage, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_exact_keeps_every_distinct_text(spark):
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (7, text(2)), (5, text(3)), (5, text(4)), (5, text(4).upper()), (6, text(3)), (8, None), (None, "")]
    got = kept(spark, corpus_pipeline.exact, rows)
    assert {(i, (t or "").lower()) for i, t in got} == {(None, text(0)), (None, text(1)), (7, text(2)), (5, text(3)), (5, text(4)), (8, "")} and len(got) == 6


def test_near_decides_by_text(spark):
    # Null ids: one linked with 9 goes, one alone stays. Id 5: its text near that of 3 goes, its other text stays.
    rows = [(None, text(0)), (9, text(0, 1)), (None, text(1)), (3, text(2)), (5, text(2, 1)), (5, text(3)), (None, text(4)), (None, text(4, 1))]
    gone = {(None, text(0)), (5, text(2, 1))}
    assert kept(spark, corpus_pipeline.near, rows) == sorted(set(rows) - gone, key=repr)


def test_class_text_is_its_own(spark):
    # Two classes with the same smallest id: each must be compared by its own n-grams.
    rows = [(1, text(k, c)) for k in range(6) for c in (0,)] + [(10 + k, text(k, 1)) for k in range(6)]
    out = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), keyed=True)
    assert "text_key" in out.columns and {(r["component_id"], r["n_links"]) for r in out.collect()} == {(1, 1)}


def test_columns_of_any_name_are_kept(spark):
    rows = [(1, text(0), "p", 1.5, 7), (2, text(0), "q", None, 8), (3, text(1), None, 2.5, None), (4, text(1, 1), "r", 0.5, 9), (5, None, "s", 1.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pair string, `a.b` double, row int")
    names = docs.columns
    for stage, left in ((corpus_pipeline.quality, {1, 2, 3, 4}), (corpus_pipeline.exact, {1, 3, 4, 5}), (corpus_pipeline.near, {1, 3, 5})):
        out = stage(spark, docs, "")
        assert out.columns == names
        want = [r for r in rows if r[0] in left] + ([rows[1]] if stage is corpus_pipeline.near and 2 in left else [])
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_exact_does_not_depend_on_partitions(spark):
    rows = [(1, "t", "en", "a"), (1, "t", "de", "b"), (1, "T", "fr", "c"), (None, "u", None, "z"), (None, "u", "en", "a"), (2, "t", "aa", "a")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        for n in (1, 2, 5):
            docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string").repartition(n)
            assert sorted(map(tuple, corpus_pipeline.exact(spark, docs, "").collect()), key=repr) == [(1, "T", "fr", "c"), (None, "u", None, "z")]
