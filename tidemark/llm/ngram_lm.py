"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Words and n-grams are known by 64-bit hashes. The hash of an n-gram or history starts with the first bits of its last
history word, so one hash range holds all n-grams of all orders around that word: one shuffle is enough for all levels.
A word with more tokens after it than a range should take is parted by the word that follows; what its histories add up to
is then put together in the shuffle that counts words.
Each range is a file in the shared folder. Workers map a file when they first need it and look up sorted batches of
distinct n-grams, so only the pages they need are read.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, buckets, fresh, read, written
from tidemark.llm._text import Piece, mix, pieces

#: Order of the model of the registered query.
ORDER = 2
CHUNK = 32 << 20
#: Files that a task keeps mapped; each takes one map and one descriptor.
MAPS = 256
#: Bits of a history word that choose its range, so the most ranges there can be. Parts of frequent words add as many again
#: at most, and the manifest has two rows for each.
BITS = 18
BEGIN, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0xE6546B64C2B2AE35)
_LOW48 = np.uint64((1 << 48) - 1)
_HEAD = np.uint64(((1 << BITS) - 1) << (64 - BITS))


def tokens(piece: Piece, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of the tokens (words in lower case, then END) of each document, of the order - 1 tokens before each (the nearest
    first, BEGIN before the document), and documents."""
    starts, stops, docs = piece.words()
    words = Piece.spans(piece.sums(lower=True), starts, stops)
    counts = np.bincount(docs, minlength=len(piece)) + 1
    ends = np.cumsum(counts)
    out = np.full(ends[-1], END)
    out[np.arange(len(words)) + docs] = words
    place = np.arange(len(out)) - np.repeat(ends - counts, counts)
    past = []
    for k in range(1, order):
        before = np.full_like(out, BEGIN)
        before[k:][place[k:] >= k] = out[:-k][place[k:] >= k]
        past.append(before)
    return out, past, np.repeat(np.arange(len(piece)), counts)


def gram_keys(history: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each history with the word after it; of a history with the word before it, too."""
    return (history & _HEAD) | (mix(mix(history) + (words & _LOW48)) & ~_HEAD)


def history_keys(past: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of the histories of one, two, ... words."""
    out = [past[0]]
    for older in past[1:]:
        out.append(gram_keys(out[-1], older))
    return out


def _range(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(64 - BITS)) * np.uint64(n)) >> np.uint64(BITS)).astype(np.int64)


@dataclass
class Ranges:
    """Where n-grams and histories are kept: one of n ranges by the first bits of the last history word, or one of the parts
    of those bits where more tokens have them than a range should take. Parts are chosen by the next word for n-grams, by
    the history itself for what it adds up to."""

    n: int
    #: Such bits in order, the number of their first part, and how many parts they have.
    bits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, n: int, total: int, frequent: list[tuple[int, int]]) -> Ranges:
        """frequent: (first bits, tokens) of those with more than total / n tokens."""
        bits, counts = np.array(sorted(frequent), np.int64).reshape(-1, 2).T
        parts = -(-counts * n // max(1, total))
        return cls(n, bits.astype(np.uint64), n + np.cumsum(parts) - parts, parts)

    def place(self, histories: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = _range(histories, self.n)
        if len(self.bits):
            bits = histories >> np.uint64(64 - BITS)
            at = np.minimum(np.searchsorted(self.bits, bits), len(self.bits) - 1)
            at, frequent = at[hit := self.bits[at] == bits], np.flatnonzero(hit)
            out[frequent] = self.first[at] + (mix(by[frequent] & _LOW48) % self.parts[at].astype(np.uint64)).astype(np.int64)
        return out


def _word_range(words: np.ndarray, n: int) -> np.ndarray:
    """Range of a word by the low 48 bits, which n-grams keep of it."""
    return (((words & _LOW48) >> np.uint64(48 - BITS)) * np.uint64(n) >> np.uint64(BITS)).astype(np.int64)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _small(x: np.ndarray) -> bytes:
    """Counts in one byte each, those of 255 and more in full at the end."""
    large = x >= 255
    return np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype("<u8").tobytes()


def _from_small(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes, from the first row on."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _encode(past: list[np.ndarray], words: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows in the order of their histories: runs of the nearest word, in them runs of the older ones (six bytes each), then
    words and counts."""
    inner = _heads(*past)
    outer = _heads(past[0][inner])
    sizes = [_small(np.diff(np.append(outer, len(inner)))), _small(np.diff(np.append(inner, len(words))))]
    numbers = np.array([len(outer), len(inner), len(words), *map(len, sizes)], "<u8")
    return b"".join([numbers.tobytes(), past[0][inner][outer].tobytes(), *sizes, *(_six(x[inner]) for x in past[1:]), _six(words), _small(counts)])


def _decode(data: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    j, k, n, a, b = (int(x) for x in np.frombuffer(data, "<u8", 5))
    nearest, at = np.frombuffer(data, "<u8", j, 40), 40 + 8 * j
    outer, inner = _from_small(data[at : at + a], j), _from_small(data[at + a : at + a + b], k)
    at += a + b
    past = [np.repeat(np.repeat(nearest, outer), inner)]
    for _ in range(order - 2):
        past.append(np.repeat(_from_six(data[at : at + 6 * k]), inner))
        at += 6 * k
    return past, _from_six(data[at : at + 6 * n]), _from_small(data[at + 6 * n :], n)


def _unique(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sums of their counts."""
    order = np.argsort(keys)
    heads = _heads(keys[order])
    return keys[order][heads], order[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens of each task follow words with the same first bits."""
    counts = np.zeros(1 << BITS, np.int64)
    for piece in pieces(batches):
        _, (before,), _ = tokens(piece, 2)
        bits, back = np.unique(before >> np.uint64(64 - BITS), return_inverse=True)
        counts[bits.astype(np.int64)] += np.bincount(back, minlength=len(bits))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["bits", "tokens"])


def _gram_counts(ranges: Ranges, order: int):
    """N-grams of each task with their counts, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []

        def pack() -> pa.RecordBatch:
            words = np.concatenate([x for x, _ in held])
            past = [np.concatenate([x[k] for _, x in held]) for k in range(order - 1)]
            histories = history_keys(past)
            _, at, counts = _unique(gram_keys(histories[-1], words), np.ones(len(words), np.int64))
            place = ranges.place(past[0][at], words[at])
            turn = np.lexsort((histories[-1][at], past[0][at], place))
            at, counts, place = at[turn], counts[turn], place[turn]
            words, past = words[at], [x[at] for x in past]
            cuts = _heads(place)
            ends = np.append(cuts[1:], len(place))
            return pa.RecordBatch.from_arrays([pa.array(place[cuts], pa.int32()), pa.array([_encode([x[a:b] for x in past], words[a:b], counts[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["bucket", "data"])

        size = 0
        for piece in pieces(batches):
            words, past, _ = tokens(piece, order)
            held.append((words, past))
            size += len(piece.data) + 100 * len(piece)
            if size >= CHUNK:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    return run


def _local(uri: str) -> str:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if ":" in uri.split("/")[0]:
        raise ValueError(f"the model is memory-mapped, so {uri} must be a mounted folder (file:)")
    return uri


def _save(folder: str, arrays: list[np.ndarray]) -> tuple[str, list[int]]:
    """Writes arrays of 64-bit numbers one after the other under a new name, and how long each is; a retried task writes
    another file, and only names in the manifest are read."""
    name = uuid.uuid4().hex
    os.makedirs(_local(folder), exist_ok=True)
    np.save(f"{_local(folder)}/{name}.npy", np.concatenate([x.astype(np.uint64).reshape(-1) for x in arrays]))
    return name, [x.size for x in arrays]


_ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("name", pa.string()), ("sizes", pa.list_(pa.int64())), ("stats", pa.list_(pa.int64()))])
_ROW_DDL = "bucket int, kind string, data binary, name string, sizes array<long>, stats array<long>"


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _totals(histories: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each history, and its total and how many words follow it once, twice, more often."""
    history, back = np.unique(histories, return_inverse=True)
    stats = np.zeros((len(history), 4), np.uint64)
    stats[:, 0] = np.bincount(back, counts, len(history))
    for i in range(3):
        stats[:, i + 1] = np.bincount(back, (counts == i + 1) if i < 2 else (counts > 2), len(history))
    return history, stats


def _held(history: np.ndarray, stats: np.ndarray) -> list[np.ndarray]:
    """Histories with their totals, and those whose total is one."""
    lone = stats[:, 0] == 1
    return [history[~lone], stats[~lone], history[lone]]


def _histories(n: int, order: int, folder: str, ranges: Ranges | None = None):
    """Merges one range of n-grams; writes the arrays of all levels (n-grams with counts over one, those counts, n-grams that
    occur once; after those of all levels the histories), and passes on how many histories each word follows there and
    how often it occurs. A part of a frequent word passes on what it adds to each history, too."""
    ranges = ranges or Ranges(n)

    def run(table: pa.Table) -> pa.Table:
        parts = [_decode(x, order) for x in table["data"].to_pylist()]
        past = [np.concatenate([p[0][k] for p in parts]) for k in range(order - 1)]
        words, counts = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        histories = history_keys(past)
        follows, back = np.unique(words, return_inverse=True)
        occurs = np.bincount(back, counts).astype(np.int64)
        bucket, total, arrays, totals, of_counts, rows = int(table["bucket"][0].as_py()), int(counts.sum()), [], [], [], []
        for k in range(order - 2, -1, -1):
            keys, at, counts = _unique(gram_keys(histories[k], words), counts)
            words, histories = words[at], [x[at] for x in histories]
            once, (history, stats) = counts == 1, _totals(histories[k], counts)
            arrays = [keys[~once], counts[~once], keys[once], *arrays]
            if bucket < n:
                totals = _held(history, stats) + totals
            else:
                place = ranges.place(history, history)
                packed = np.column_stack([np.full(len(history), k, np.uint64), history, stats])
                rows += [{"bucket": int(b), "kind": "stats", "data": packed[place == b].astype("<u8").tobytes()} for b in np.unique(place)]
            of_counts = _of_counts(counts) + of_counts
            counts = np.ones(len(words), np.int64)  # lower levels count the different n-grams that end in each
        times = np.bincount(np.searchsorted(follows, words), minlength=len(follows))
        name, sizes = _save(folder, arrays + totals)
        place = _word_range(follows, n)
        cuts = _heads(place)
        ends = np.append(cuts[1:], len(place))
        rows.insert(0, {"bucket": bucket, "kind": "grams", "name": name, "sizes": sizes, "stats": [total, *of_counts]})
        rows += [{"bucket": int(place[a]), "kind": "words", "data": np.uint64(b - a).tobytes() + _six(follows[a:b]) + np.uint64(len(x := _small(times[a:b]))).tobytes() + x + _small(occurs[a:b])} for a, b in zip(cuts, ends, strict=True)]
        return pa.Table.from_pylist(rows, _ROW)

    return run


def _word_rows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int(np.frombuffer(data, "<u8", 1)[0])
    at = 16 + 6 * k
    size = int(np.frombuffer(data, "<u8", 1, at - 8)[0])
    return _from_six(data[8 : at - 8]), _from_small(data[at : at + size], k), _from_small(data[at + size :], k)


def _words(order: int, folder: str):
    """Adds up one range of words, or of the histories of frequent words; rows of the step before that name files pass through."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [r for r in rows if r["kind"] == "grams"]
        parts = [_word_rows(r["data"]) for r in rows if r["kind"] == "words"]
        if parts:
            words, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            times, occurs = (np.bincount(back, np.concatenate([p[i] for p in parts])).astype(np.int64) for i in (1, 2))
            several = occurs > 1
            name, sizes = _save(folder, [words[several], times[several], occurs[several], words[~several]])
            out.append({"bucket": rows[0]["bucket"], "kind": "words", "data": None, "name": name, "sizes": sizes, "stats": [int(times.sum()), len(words), *_of_counts(times)]})
        parts = [np.frombuffer(r["data"], "<u8").reshape(-1, 6) for r in rows if r["kind"] == "stats"]
        if parts:
            added, arrays = np.concatenate(parts), []
            for k in range(order - 1):
                mine = added[added[:, 0] == k]
                history, back = np.unique(mine[:, 1], return_inverse=True)
                stats = np.zeros((len(history), 4), np.uint64)
                np.add.at(stats, back, mine[:, 2:])
                arrays += _held(history, stats)
            name, sizes = _save(folder, arrays)
            out.append({"bucket": rows[0]["bucket"], "kind": "stats", "data": None, "name": name, "sizes": sizes, "stats": None})
        return pa.Table.from_pylist(out, _ROW)

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more from how many counts are 1, 2, 3, 4. A discount that
    these do not place between 0 and its count, as in small corpora, is three quarters."""
    out = np.array([0, 0.75, 0.75, 0.75])
    if all(n):
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            found = k - (k + 1) * y * n[k] / n[k - 1]
            out[k] = found if 0 < found < k else 0.75
    return out


@dataclass
class Model:
    """Where the arrays are and the few numbers about the whole corpus; small enough to go with each task."""

    order: int
    ranges: Ranges
    folder: str
    files: dict[tuple[str, int], tuple[str, list[int]]]
    train_tokens: int
    types: int
    #: Of each level from two words on, and of the lowest.
    discounts: list[np.ndarray]
    word_discounts: np.ndarray
    word_counts: list[int]
    pair_types: int

    def spread(self) -> float:
        """Share of the lowest level's mass that goes to all words alike."""
        d, n = self.word_discounts, self.word_counts
        return float(d[1] * n[0] + d[2] * n[1] + d[3] * (self.types - n[0] - n[1])) / max(1, self.pair_types)


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Counts n-grams over all rows of docs and writes the model's arrays to the shared folder.

    The highest level takes counts, lower ones how many different words come before each n-gram; histories at the start
    of a text are filled up with BEGIN.
    """
    if order < 2:
        raise ValueError("the model needs an order of two at least")
    spark = docs.sparkSession
    n, folder = min(buckets(docs, text_col), 1 << BITS), fresh(spark, "grams")
    rows = docs.select(F.col(text_col).alias("text"))
    leads = written(rows.mapInArrow(_leads, "bits long, tokens long").groupBy("bits").agg(F.sum("tokens").alias("tokens")), "leads")
    total = leads.agg(F.sum("tokens")).first()[0] or 0
    ranges = Ranges.of(n, total, [tuple(r) for r in leads.filter(F.col("tokens") > total / n).collect()])
    counted = rows.mapInArrow(_gram_counts(ranges, order), "bucket int, data binary")
    merged = counted.groupBy("bucket").applyInArrow(_histories(n, order, folder, ranges), _ROW_DDL)
    manifest = written(merged.groupBy("bucket").applyInArrow(_words(order, folder), _ROW_DDL).drop("data"), "manifest").collect()
    grams = [r for r in manifest if r["kind"] == "grams"]
    words = [r for r in manifest if r["kind"] == "words"]
    add = lambda rows, i: sum(r["stats"][i] for r in rows)
    levels = [discounts([add(grams, 1 + 4 * k + i) for i in range(4)]) for k in range(order - 1)]
    word_counts = [add(words, i) for i in range(2, 6)]
    files = {(r["kind"], r["bucket"]): (r["name"], r["sizes"]) for r in manifest}
    return Model(order, ranges, folder, files, add(grams, 0), add(words, 1), levels, discounts(word_counts), word_counts, add(words, 0))


class Lookup:
    """Memory-mapped arrays of a model, each file mapped when first asked for."""

    def __init__(self, model: Model):
        self.model = model
        self.maps: OrderedDict[tuple[str, int], list[np.ndarray]] = OrderedDict()

    def arrays(self, kind: str, bucket: int) -> list[np.ndarray] | None:
        key = (kind, bucket)
        if key not in self.model.files:
            return None
        if key not in self.maps:
            name, sizes = self.model.files[key]
            self.maps[key] = np.split(np.load(f"{_local(self.model.folder)}/{name}.npy", mmap_mode="r"), np.cumsum(sizes)[:-1])
            if len(self.maps) > MAPS:
                self.maps.popitem(last=False)
        self.maps.move_to_end(key)
        return self.maps[key]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted wanted keys that are there, and which they are."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == wanted)
        return hit, at[hit]

    def _by_range(self, kind: str, place: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Arrays of each range, and which of the wanted are there; kind totals: those of histories."""
        order = np.argsort(place, kind="stable")
        for mine in np.split(order, _heads(place[order])[1:]):
            if not len(mine):
                continue
            b = int(place[mine[0]])
            arrays = self.arrays(kind if kind != "totals" else "grams" if b < self.model.ranges.n else "stats", b)
            if arrays is not None:
                yield arrays[-3 * (self.model.order - 1) :] if kind == "totals" else arrays, mine

    def history(self, level: int, wanted: np.ndarray) -> np.ndarray:
        """Total of each (sorted) history of level + 1 words, and how many words follow it once, twice, more often."""
        out = np.zeros((len(wanted), 4))
        for arrays, mine in self._by_range("totals", self.model.ranges.place(wanted, wanted)):
            histories, stats, lone = arrays[3 * level : 3 * level + 3]
            hit, at = self._find(histories, wanted[mine])
            out[mine[hit]] = stats.reshape(-1, 4)[at]
            hit, _ = self._find(lone, wanted[mine])
            out[mine[hit], :2] = 1
        return out

    def gram(self, level: int, wanted: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Count of each (sorted) n-gram; words: the last of each."""
        out = np.zeros(len(wanted))
        for arrays, mine in self._by_range("grams", self.model.ranges.place(wanted, words)):
            keys, counts, singles = arrays[3 * level : 3 * level + 3]
            hit, at = self._find(keys, wanted[mine])
            out[mine[hit]] = counts[at]
            hit, _ = self._find(singles, wanted[mine])
            out[mine[hit]] = 1
        return out

    def words(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many histories each word (sorted low 48 bits) follows, and how often it occurs."""
        times, occurs = np.zeros(len(wanted)), np.zeros(len(wanted))
        for (words, follows, counts, lone), mine in self._by_range("words", _word_range(wanted, self.model.ranges.n)):
            hit, at = self._find(words, wanted[mine])
            times[mine[hit]], occurs[mine[hit]] = follows[at], counts[at]
            hit, _ = self._find(lone, wanted[mine])
            times[mine[hit]] = occurs[mine[hit]] = 1
        return times, occurs

    def score(self, words: np.ndarray, past: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, base score and model score (log10 of the probability) of each token after those before it."""
        m = self.model
        types, back = np.unique(words & _LOW48, return_inverse=True)
        times, count = self.words(types)
        p = np.maximum(times - m.word_discounts[np.minimum(times, 3).astype(int)], 0) / max(1, m.pair_types)
        p = (p + (m.spread() if m.pair_types else 1.0) / (m.types + 1))[back]
        base = np.log10((count + 1) / (m.train_tokens + m.types + 1))
        for level, history in enumerate(history_keys(past)):
            held, place = np.unique(history, return_inverse=True)
            known = self.history(level, held)
            keys, one, again = np.unique(gram_keys(history, words), return_index=True, return_inverse=True)
            joint = self.gram(level, keys, words[one])[again]
            d = m.discounts[level]
            total, rest = known[:, 0][place], (known[:, 1:] @ d[1:])[place]
            seen = total > 0
            safe = np.where(seen, total, 1)
            direct = np.where(seen, np.maximum(joint - d[np.minimum(joint, 3).astype(int)], 0) / safe, 0)
            p = direct + np.where(seen, rest / safe, 1) * p
        return count[back], base[back], np.log10(p)


def lm_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, base_score, score (log10) and perplexity of the whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for piece in pieces(batches, limit=4 << 20):
            words, past, of = tokens(piece, model.order)
            count, base, score = lookup.score(words, past)
            add = lambda x: np.bincount(of, x, minlength=len(piece))  # noqa: B023, E731
            n, total = add(np.ones(len(of))), add(score)
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), pa.array(n.astype(np.int64)), pa.array(add(count > 0).astype(np.int64)), pa.array(add(base)), pa.array(total), pa.array(10 ** (-total / n))], names=["id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def lm_scoring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, order: int = ORDER) -> DataFrame:
    """Fits a model of `order` words on the rows outside one fold (crc32 of the id as text) and scores all rows: id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity.

    Tokens are words in lower case (A-Z), then one end. Null and empty texts are the end alone. Rows with a null id are
    trained on. Repeated rows count as often as they occur. With nothing to train on, every token has the probability of
    an unknown word, 1. Other columns are ignored; an empty table gives an empty result.
    """
    out_of = held_out(id_col, folds, fold)
    model = fit(docs.filter(~out_of), text_col, order)
    scores = lm_scores(docs, model, id_col, text_col)
    return scores.withColumns({"held_out": held_out(id_col, folds, fold), "train_tokens": F.lit(model.train_tokens).cast("bigint")})


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return lm_scoring(read(spark, sf_dir, "documents"))
