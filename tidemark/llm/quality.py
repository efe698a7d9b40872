"""Quality rules on whole texts, with repeated passages found by a suffix array over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, read
from tidemark.llm._text import Piece, mix, pieces, windows

#: Base rule: fewest words, and the most words in repeated five-word windows, in hundredths.
MIN_WORDS, BASE_WORDS, BASE_PERCENT = 10, 5, 20
#: Method's rule: repeats of at least so many words may cover at most this share of the words, and none may be longer than the limit.
REPEAT_WORDS, MAX_FRACTION, MAX_REPEAT = 10, 0.15, 60

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80


def suffix_array(words: np.ndarray, docs: np.ndarray, least: int = BASE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of each document (words: hashes; docs: ascending document numbers) that share at least `least` first
    words with another of the same document, in suffix order, and the longest common prefix of each with the one
    before it (0: another document or fewer than `least` words).

    The order of single words is that of their hashes. Suffixes are first grouped by their first `least` words, then
    ordered by prefix doubling; groups that are down to one suffix take no further part.
    """
    n = len(words)
    grams, at = windows(words, docs, least)
    keys = mix(grams ^ (docs[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    shared = same[1:] | same[:-1]
    suffixes, heads = at[order[shared]], ~same[:-1][shared]
    if not len(suffixes):
        return suffixes, np.zeros(0, np.int64)
    rank = np.arange(n + 1, dtype=np.int64) + len(suffixes)
    place = np.arange(len(suffixes))
    group = np.maximum.accumulate(np.where(heads, place, 0))
    rank[suffixes] = group
    levels, depth = [(least, rank)], least
    open_ = place
    while True:
        alone = heads[open_] & np.append(heads[open_][1:], True)
        open_ = open_[~alone]
        if not len(open_):
            break
        mine = suffixes[open_]
        follow = mine + depth
        ends = (follow >= n) | (docs[np.minimum(follow, n - 1)] != docs[mine])
        second = np.where(ends, -1 - mine, rank[np.minimum(follow, n)]) + n + 1
        turn = np.lexsort((second, group[open_]))
        first, then = group[open_][turn], second[turn]
        suffixes[open_] = mine[turn]
        heads[open_[1:]] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        group = np.maximum.accumulate(np.where(heads, place, 0))
        rank = rank.copy()
        rank[suffixes[open_]] = group[open_]
        depth *= 2
        levels.append((depth, rank))
    a, b = suffixes[:-1], suffixes[1:]
    shift = np.zeros(len(a), np.int64)
    for length, ranks in reversed(levels):
        shift += np.where(ranks[np.minimum(a + shift, n)] == ranks[np.minimum(b + shift, n)], length, 0)
    going = shift > 0
    for _ in range(least - 1):
        i, j = a + shift, b + shift
        inside = going & (i < n) & (j < n)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        going = inside & (docs[i] == docs[a]) & (docs[j] == docs[b]) & (words[i] == words[j])
        shift += going
    return suffixes, np.concatenate([[0], shift])


def repeats(words: np.ndarray, docs: np.ndarray, least: int = BASE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest repeat that begins at each suffix with one: their union is that of all
    maximal repeated substrings of at least `least` words."""
    suffixes, common = suffix_array(words, docs, least)
    return suffixes, np.maximum(common, np.append(common[1:], 0))


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Flags of the places in the union of spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _duplicate_lines(piece: Piece, sums: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the document, by document."""
    n, docs = len(piece.data), len(piece)
    begins = np.unique(np.concatenate([piece.bounds[:-1], np.flatnonzero(piece.data == 10) + 1]))
    begins = begins[begins < n]
    if not len(begins):
        return np.zeros(docs, np.int64)
    of = np.searchsorted(piece.bounds, begins, "right") - 1
    stops = np.minimum(np.append(begins[1:], n), piece.bounds[of + 1])
    stops = np.where((stops > begins) & (piece.data[stops - 1] == 10), stops - 1, stops)
    full = np.searchsorted(word_starts, stops) > np.searchsorted(word_starts, begins)
    keys = mix(Piece.spans(sums, begins[full], stops[full]) ^ (of[full].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(of[full], minlength=docs) - np.bincount(of[full][first], minlength=docs)


def measures(piece: Piece, repeat_words: int = REPEAT_WORDS) -> dict[str, np.ndarray]:
    starts, stops, docs = piece.words()
    sums, count = piece.sums(lower=False), len(piece)
    words = Piece.spans(sums, starts, stops)
    in_word = np.zeros(len(piece.data) + 1, np.int64)
    np.add.at(in_word, starts, 1)
    np.add.at(in_word, stops, -1)
    at, lengths = repeats(words, docs)
    long = lengths >= repeat_words
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, docs[at], lengths)
    by_doc = lambda flags: np.bincount(docs[flags], minlength=count)
    return {
        "n_words": np.bincount(docs, minlength=count),
        "word_chars": piece.totals((np.cumsum(in_word[:-1]) > 0) & _LEADS[piece.data]),
        "n_symbols": piece.totals(_IS_SYMBOL[piece.data]),
        "n_dup_lines": _duplicate_lines(piece, sums, starts),
        "n_repeat_words": by_doc(covered(at, lengths, len(words))),
        "n_long_repeat_words": by_doc(covered(at[long], lengths[long], len(words))),
        "longest_repeat": longest,
    }


def verdicts(found: dict[str, np.ndarray], max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept from measures()."""
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > BASE_PERCENT * found["n_words"])
    return failed, ~failed & (found["n_long_repeat_words"] <= max_fraction * found["n_words"]) & (found["longest_repeat"] <= max_repeat)


def quality_filter(docs: DataFrame, text_col: str = "text", repeat_words: int = REPEAT_WORDS, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns, whatever their names: one pass without a shuffle."""
    place = [f"c{i}" for i in range(len(docs.columns))]
    text = place[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            yield piece.rows.filter(pa.array(verdicts(measures(piece, repeat_words), max_fraction, max_repeat)[1]))

    plain = docs.toDF(*place)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_words: int = REPEAT_WORDS, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per row of docs, in any order: id, measures of the whole text, base_failed and kept.

    A text is kept when the base rule holds (at least 10 words, at most 20 in 100 of them in repeated five-word
    windows), repeats of at least repeat_words words cover at most max_fraction of the words, and no repeat is longer
    than max_repeat words. Repeats are those inside one text; lengths count words.

    Null and empty texts have no words and fail the base rule. Null ids and repeated rows are judged like any other.
    Other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_repeat_words", "longest_repeat"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = measures(piece, repeat_words)
            flags = verdicts(found, max_fraction, max_repeat)
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), *(pa.array(found[k], pa.int64()) for k in names), *map(pa.array, flags)], names=["id", *names, "base_failed", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(measure, f"id {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean")
    return out.withColumnRenamed("id", id_col)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return quality_rules(read(spark, sf_dir, "documents"))
