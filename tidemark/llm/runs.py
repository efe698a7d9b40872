"""Periodic runs of words, found in linear time from Lyndon arrays on ordered alphabets.

Ellert and Fischer's way: for the order of words and for its reverse, the next smaller suffix of each place ends the
longest Lyndon word there, and the period of every run is the length of such a word that the text goes on with. Suffixes
are compared with a stack from left to right. What a comparison matched is kept with its edge, so where a stretch is
known to repeat an earlier one, comparisons inside it are looked up there, and only words beyond the farthest place ever
matched are compared anew. No suffix array or tree, and no hashes: words are numbered in their order by sorting bytes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, read
from tidemark.llm._text import Piece, pieces

#: A run counts from so many words, and so many times its period, on.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_SPACE = "[\\x20\\x09-\\x0D]+"


def ranks(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The place of each word among the distinct words of data, in the order of their bytes: words are sorted by eight
    bytes, and those that are still equal and go on by the next eight."""
    lengths = stops - starts
    group = np.zeros(len(starts), np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    open_, depth = np.arange(len(starts)), 0
    while len(open_):
        at = starts[open_] + depth
        key = np.zeros(len(open_), np.uint64)
        for k in range(8):
            byte = np.where(depth + k < lengths[open_], padded[np.minimum(at + k, len(data))], 0)
            key = (key << np.uint64(8)) | byte.astype(np.uint64)
        left = np.minimum(lengths[open_] - depth, 9)  # tells a word's end from a zero byte, and words that go on
        order = np.lexsort((left, key, group[open_]))
        g, k, n = group[open_][order], key[order], left[order]
        new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1]))
        # All words of a group are open together, so a part's number is its group's and how many of it come before.
        first = np.append(True, g[1:] != g[:-1])
        place = np.arange(len(g))
        inside = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        group[open_[order]] = g + inside
        sizes = np.diff(np.append(np.flatnonzero(new), len(g)))
        several = np.repeat(sizes > 1, sizes)
        still = open_[order[several]]
        depth += 8
        open_ = np.sort(still[lengths[still] > depth])
    return group


def lyndon_edges(words: array) -> tuple[array, array]:
    """For each place the next smaller suffix (len(words): none) and how many words the two have in common.

    Negative words end a text: they are smaller than all others and must differ from each other. Comparisons of words
    are at most a small multiple of len(words), whatever the text.
    """
    n = len(words)
    after, common = array("i", [n]) * n, array("i", bytes(4 * n))  # next smaller suffix, and the match with it
    before, shared = array("i", [-1]) * n, array("i", bytes(4 * n))  # previous smaller suffix, and the match with it
    left = right = reach = 0  # words[right:reach] are words[left:...]; none were matched beyond reach
    for r in range(1, n):
        word, l, matched, last = words[r], r - 1, 0, -1
        while l >= 0:
            other = words[l]
            if other != word:
                matched = 0
            else:
                known, start, base = -1, 0, l - (right - left)
                if right < r < reach and base >= left:  # a copy of an earlier comparison, as far as is known
                    copy = r - (right - left)
                    found = common[base] if after[base] == copy else shared[copy] if before[copy] == base else -1
                    if 0 <= found < reach - r:
                        known = found
                    elif found >= 0:
                        start = reach - r
                elif last >= 0:  # words[last:] has `matched` words in common with r, and shared[last] with l
                    known = matched if shared[last] > matched else shared[last] if shared[last] < matched else -1
                    start = matched
                if known < 0:
                    i, j = l + start, r + start
                    while j < n and words[i] == words[j]:
                        i += 1
                        j += 1
                    known = j - r
                    if j >= reach:
                        left, right, reach = l, r, j
                matched = known
                if r + matched < n:
                    other, word = words[l + matched], words[r + matched]
                else:
                    other, word = 0, -1
            smaller = other < word
            if matched:
                word = words[r]
            if smaller:
                shared[r] = matched
                break
            after[l], common[l] = r, matched
            last, l = l, before[l]
        before[r] = l
    return after, common


def find_runs(words: np.ndarray, docs: np.ndarray, count: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs in texts (docs: the ascending text of each word; count: how many there are) that
    are long enough, by start and period; least_periods is 3 at least."""
    n = len(words)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    # A word of its own after each text; places in what is compared, and places of words.
    place = np.arange(n) + docs
    size = n + count
    flat = np.full(size, -1, np.int64)
    flat[place] = words
    ends = np.flatnonzero(flat < 0)
    found: set[tuple[int, int, int]] = set()
    for sign in (1, -1):
        both = np.full(size, -1, np.int32)
        both[place] = words if sign > 0 else words.max() - words
        both[ends] = -1 - np.arange(len(ends))
        after, common = (np.frombuffer(x, np.int32) for x in lyndon_edges(array("i", both.tobytes())))
        period = after - np.arange(size)
        # The first root of a run that is long enough goes on for at least least_periods - 2 periods and a word.
        for i in np.flatnonzero(common > (least_periods - 2) * period).tolist():
            p, back = int(period[i]), 0
            while back < p and i - back > 0 and flat[i - back - 1] == flat[i - back - 1 + p] and flat[i - back - 1] >= 0:
                back += 1
            length = back + p + int(common[i])
            if back < p and length >= max(least_words, least_periods * p):
                found.add((i - back, length, p))
    runs = np.array(sorted(found, key=lambda x: (x[0], x[2])), np.int64).reshape(-1, 3)
    starts = runs[:, 0]
    return starts - np.searchsorted(ends, starts), runs[:, 1], runs[:, 2]


def _periodic(least_words: int, least_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            starts, stops, docs = piece.words()
            at, lengths, periods = find_runs(ranks(piece.data, starts, stops), docs, len(piece), least_words, least_periods)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, at + periods, 1)
            np.add.at(change, at + lengths, -1)
            kept = np.cumsum(change[:-1]) == 0
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), _lists(at, lengths, periods, docs, len(piece)), _joined(piece, starts[kept], stops[kept], docs[kept])], names=["id", "runs", "collapsed"])

    return run


def _lists(at: np.ndarray, lengths: np.ndarray, periods: np.ndarray, docs: np.ndarray, count: int) -> pa.Array:
    of = docs[at]
    bounds = np.searchsorted(of, np.arange(count + 1)).astype(np.int32)
    first = np.searchsorted(docs, np.arange(count))
    fields = [pa.array(x, pa.int64()) for x in (at - first[of], lengths, periods)]
    return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def _joined(piece: Piece, starts: np.ndarray, stops: np.ndarray, docs: np.ndarray) -> pa.Array:
    """The words of each text joined by one space."""
    sizes = stops - starts + 1  # with the space after each
    sizes[np.append(docs[1:] != docs[:-1], True)[: len(docs)]] -= 1
    out_ends = np.cumsum(sizes)
    data = np.full(int(out_ends[-1]) if len(sizes) else 0, 32, np.uint8)
    lengths = stops - starts
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    data[np.repeat(out_ends - sizes, lengths) + inside] = piece.data[np.repeat(starts, lengths) + inside]
    last = np.searchsorted(docs, np.arange(len(piece) + 1))
    bounds = np.append(0, out_ends)[last].astype(np.int32)
    return pa.StringArray.from_buffers(len(piece), pa.py_buffer(bounds), pa.py_buffer(data))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per row of docs: id, runs (start, length, period; word numbers from 0, by start, then period) and collapsed, the
    words of the text joined by one space, without those that some run holds after its first period.

    A run is a longest stretch of words with a smallest period q (words q apart are identical bytes) that is at least
    least_words and least_periods * q words long (least_periods 3 or more). One pass without a shuffle; a task holds one
    piece of about 1 MB, or one longer text, at a time.

    Null, empty and word-less texts have no runs and collapse to an empty text, never null. Null ids and repeated rows
    are rows like others. Other columns are ignored; an empty table gives an empty result.
    """
    if least_periods < 3:
        raise ValueError("least_periods must be 3 or more")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_periodic(least_words, least_periods), f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def looped(doc_id: Column, text: Column) -> Column:
    """The text of each tenth document by the hash of its id turned into a loop: from word a on, a period of p words repeats.
    Null ids and texts without words stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words).cast("long")
    a, times = g % n, 3 + g % 8
    p = 1 + F.floor((n - a) / times)  # so that `times` periods reach the end
    loop = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times.cast("int")))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), loop), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(whole, " ")).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("_best")
    return found.withColumn("_best", first).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"), F.floor(1000 * best["length"] / (-best["period"])).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = read(spark, sf_dir, "documents")
    return digest(periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))))
