"""Exact n-gram Jaccard join: candidate filters on hashed prefixes, then a prefix-tree join inside each candidate cluster.

1. Every text becomes a set of hashed word n-grams; equal sets form one class, known by a 128-bit hash of the set.
2. Linked sets x and y share at least ceil(T max(|x|, |y|)) n-grams, so of the smallest hashes of each, a prefix of
   |x| - ceil(T |x|) + c holds c common ones. A class with too few prefix n-grams that any other class has is out.
   N-grams that very many classes have are found first, and dealt by class: their frequencies are known by then.
3. Of those n-grams a class keeps all but its most frequent ones (as many as can be spared); classes that share a kept
   one are candidates, and their connected components are the clusters.
4. In each cluster the sets, ordered from the rarest n-gram to the commonest, form a trie. All members walk it at once:
   a node holds the overlap of its path with every member, which its children share, and a subtree is left when no
   member can reach the threshold with what remains. In a cluster that is too large for one task, sets are dealt by
   size: linked ones are of the same or of neighbouring size levels, so only blocks of those are joined in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, buckets, read, written
from tidemark.llm._text import Piece, mix, pieces, windows
from tidemark.llm.components import connected_components

WORDS, PERCENT = 5, 80
CHUNK = 16 << 20
#: Sets, and n-grams in them, that one task takes of a cluster; larger clusters are joined by pairs of such blocks.
BLOCK, BLOCK_GRAMS = 1024, 4 << 20
#: An n-gram with more than one in HOT of all prefix rows is dealt by class; there are fewer than HOT of them.
HOT = 1000
_LOW48 = np.uint64((1 << 48) - 1)


def spare(n: np.ndarray) -> np.ndarray:
    """Common n-grams asked for in the prefixes of sets of n."""
    return np.maximum(1, np.asarray(n) // 10)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * np.asarray(n) // 100)


def shingle_sets(piece: Piece, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each document in ascending order, one after the other, and where each begins."""
    starts, stops, docs = piece.words()
    words = Piece.spans(piece.sums(lower=True), starts, stops)
    grams, at = windows(words, docs, n)
    of = docs[at]
    counts = np.bincount(docs, minlength=len(piece))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(docs, short)
        extra = []
        for d, a in zip(short.tolist(), first.tolist(), strict=True):
            value = np.uint64(counts[d])
            for w in words[a : a + counts[d]]:
                value = mix(np.array([value ^ w], np.uint64))[0]
            extra.append(value)
        grams, of = np.concatenate([grams, np.array(extra, np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    grams = grams.copy()
    bounds = np.searchsorted(of, np.arange(len(piece) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], np.searchsorted(of[new], np.arange(len(piece) + 1))


#: A class's 128 bits, as numpy holds them.
KEY = np.dtype("S16")


def class_keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set, as one key."""
    sizes, out = np.diff(bounds), np.empty((len(bounds) - 1, 2), np.uint64)
    for i, salt in enumerate((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)))])
        out[:, i] = mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ sizes.astype(np.uint64))
    return out.view(KEY).reshape(-1)


def keys_out(keys: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())


def keys_in(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), KEY)


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            grams, bounds = shingle_sets(piece, n)
            key = piece.rows.column(piece.rows.schema.get_field_index("text_key"))
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), key, pa.array(np.diff(bounds), pa.int64()), keys_out(class_keys(grams, bounds))], names=["id", "text_key", "n_shingles", "class"])

    return run


def _low6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from6(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _encode(classes: np.ndarray, grams: np.ndarray) -> bytes:
    """Runs of equal classes, then six bytes of each n-gram."""
    heads = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    counts = np.diff(np.append(heads, len(classes))).astype("<u4")
    return np.uint32(len(heads)).tobytes() + classes[heads].tobytes() + counts.tobytes() + _low6(grams)


def _decode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct classes of several such tables in order, and of each n-gram its class's place among them."""
    heads, counts, grams = [np.zeros(0, KEY)], [np.zeros(0, "<u4")], [np.zeros(0, np.uint64)]
    for data in parts:
        k = int(np.frombuffer(data, "<u4", 1)[0])
        heads.append(np.frombuffer(data, KEY, k, 4))
        counts.append(np.frombuffer(data, "<u4", k, 4 + 16 * k))
        grams.append(_from6(data[4 + 20 * k :]))
    names, place = np.unique(np.concatenate(heads), return_inverse=True)
    return names, np.repeat(place, np.concatenate(counts)), np.concatenate(grams)


def _deal(keys: np.ndarray, classes: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(keys, kind="stable")
    keys, classes, grams = keys[order], classes[order], grams[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(keys)) if len(keys) else cuts
    return pa.RecordBatch.from_arrays([pa.array(keys[cuts], pa.int32()), pa.array([_encode(classes[a:b], grams[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["bucket", "data"])


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes and n-grams (48 bits) of the prefixes of the distinct sets of each chunk."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[bytes] = set()

    def pack() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, KEY), *(x for x, _ in held)]), np.concatenate([np.zeros(0, np.uint64), *(x for _, x in held)])

    size = 0
    for piece in pieces(batches):
        grams, bounds = shingle_sets(piece, words)
        keys, counts = class_keys(grams, bounds), np.diff(bounds)
        new = np.zeros(len(piece), bool)
        for i, k in enumerate(keys.tolist()):
            if k not in seen and counts[i]:
                seen.add(k)
                new[i] = True
        take = np.where(new, counts - least_overlap(counts, percent) + spare(counts), 0)
        take = np.minimum(take, counts)
        place = np.arange(len(grams)) - np.repeat(bounds[:-1], counts)
        held.append((np.repeat(keys, take), grams[place < np.repeat(take, counts)] & _LOW48))
        size += len(piece.data)
        if size >= CHUNK:
            yield pack()
            held, size, seen = [], 0, set()
    yield pack()


def _heavy(words: int, percent: int):
    """N-grams that several sets of a chunk and one in HOT of its prefix rows have, and (without an n-gram) all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in _prefixes(batches, words, percent):
            values, counts = np.unique(grams, return_counts=True)
            heavy = counts >= max(2, len(grams) / HOT)
            found = [None, *values[heavy].astype(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([len(grams), *counts[heavy].tolist()], pa.int64())], names=["gram", "rows"])

    return run


def hot_grams(rows: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (ascending) that surely have more than one in HOT of all prefix rows, with the rows so known; any other
    has at most two in HOT, and one row a chunk."""
    known = written(rows.mapInArrow(_heavy(words, percent), "gram long, rows long").groupBy("gram").agg(F.sum("rows").alias("rows")), "heavy")
    total = known.filter("gram is null").agg(F.sum("rows")).first()[0] or 0
    found = sorted(known.filter(F.col("gram").isNotNull() & (F.col("rows") * HOT > total)).select("gram", "rows").collect())
    return np.array([x["gram"] for x in found], np.uint64), np.array([x["rows"] for x in found], np.int64)


def _ranges(classes: np.ndarray, grams: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """One of n ranges of n-grams; for hot ones, one of n more by class."""
    by_class = (classes.view("<u8").reshape(-1, 2)[:, 0] % np.uint64(n)).astype(np.int32)
    return np.where(np.isin(grams, hot), n + by_class, (grams % np.uint64(n)).astype(np.int32)).astype(np.int32)


def _prefix_rows(n: int, words: int, percent: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for classes, grams in _prefixes(batches, words, percent):
            yield _deal(_ranges(classes, grams, hot, n), classes, grams)

    return run


_SHARED = np.dtype([("docs", "<u8"), ("gram", "<u8")])


def _shared_grams(table: pa.Table, n: int, hot: np.ndarray, rows_of_hot: np.ndarray) -> pa.Table:
    """Of one range of n-grams, those that several classes have, with their number (of hot ones, the rows known), by class."""
    names, classes, grams = _decode(table["data"].to_pylist())
    order = np.lexsort((classes, grams))
    classes, grams = classes[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (classes[1:] != classes[:-1])
    classes, grams = classes[new], grams[new]
    if table["bucket"][0].as_py() >= n:
        docs = rows_of_hot[np.searchsorted(hot, grams)]
    else:
        _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
        docs = counts[back]
    several = docs > 1
    rows = np.zeros(int(several.sum()), _SHARED)
    rows["docs"], rows["gram"] = docs[several], grams[several]
    classes = classes[several]
    order = np.argsort(classes, kind="stable")
    classes, rows = classes[order], rows[order]
    cuts = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])) if len(classes) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(classes)) if len(classes) else cuts
    return pa.table({"class": keys_out(names[classes[cuts]]), "data": pa.array([rows[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})


def _kept_grams(n: int, percent: int, hot: np.ndarray):
    """Drops classes with too few shared n-grams, and of the others the most frequent ones that can be spared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            classes, grams = [], []
            for key, size, data in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                least = int(spare(least_overlap(size, percent)))
                found = np.frombuffer(b"".join(data), _SHARED)
                if len(found) >= least:
                    kept = found["gram"][np.lexsort((found["gram"], found["docs"]))][: len(found) - least + 1]
                    classes.append(np.full(len(kept), key, KEY))
                    grams.append(kept)
            classes, grams = np.concatenate([np.zeros(0, KEY), *classes]), np.concatenate([np.zeros(0, np.uint64), *grams])
            yield _deal(_ranges(classes, grams, hot, n), classes, grams)

    return run


def _stars(table: pa.Table, n: int) -> pa.Table:
    """Joins the classes of each kept n-gram to the smallest of them; where others of the n-gram's classes are in other
    ranges, that one is joined to a node that stands for the n-gram."""
    names, classes, grams = _decode(table["data"].to_pylist())
    order = np.lexsort((classes, grams))
    classes, grams = classes[order], grams[order]
    first = np.append(True, grams[1:] != grams[:-1]) if len(grams) else np.zeros(0, bool)
    root = classes[np.maximum.accumulate(np.where(first, np.arange(len(grams)), 0))] if len(grams) else classes
    pairs = np.unique(np.stack([classes, root], 1)[classes != root], axis=0).reshape(-1, 2)
    a, b = names[pairs[:, 0]], names[pairs[:, 1]]
    if len(grams) and table["bucket"][0].as_py() >= n:
        nodes = np.stack([grams[first], np.full(int(first.sum()), ~np.uint64(0))], 1).view(KEY).reshape(-1)
        a, b = np.concatenate([a, names[root[first]]]), np.concatenate([b, nodes])
    return pa.table({"a": keys_out(a), "b": keys_out(b)})


_SET = ("cluster", "class", "weight", "cells")
_SET_DDL = "cluster binary, class binary, weight long, cells array<struct<place:string,part:string>>"


def _full_sets(words: int):
    """The set of each text, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            grams, bounds = shingle_sets(piece, words)
            sets = [grams[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.rows.column(piece.rows.schema.get_field_index(k)) for k in _SET), pa.array(sets, pa.binary())], names=[*_SET, "grams"])

    return run


def _with_cells(members: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """members (class, cluster, n_shingles, ...) with cells: the places where each is joined, and its part there.

    A size level spans a factor of 100 / percent (a little more, so that rounding cannot part linked sets): linked sets
    are at most one level apart. Levels are cut into parts, and a part meets the parts of its own and both neighbouring
    levels. Clusters that fit one task are packed together.
    """
    level = F.floor(F.log(100 / percent * 1.001, F.col("n_shingles"))).cast("int")
    members = members.withColumn("level", level)
    by, all_ = W.partitionBy("cluster").orderBy("level"), W.partitionBy("cluster")
    sizes = members.groupBy("cluster", "level").agg(F.count(F.lit(1)).alias("count"), F.sum("n_shingles").alias("grams"))
    sizes = sizes.withColumn("parts", F.ceil(F.greatest(F.col("count") / block, F.col("grams") / BLOCK_GRAMS)).cast("int"))
    beside = lambda f: F.coalesce(F.when(F.abs(f("level").over(by) - F.col("level")) == 1, f("parts").over(by)), F.lit(0))
    large = (F.sum("count").over(all_) > block) | (F.sum("grams").over(all_) > BLOCK_GRAMS)
    sizes = sizes.select("cluster", "level", "parts", beside(F.lag).alias("below"), beside(F.lead).alias("above"), large.alias("large"))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    name = lambda level, part: F.concat_ws(".", level, part)
    own = name(F.col("level"), F.col("part"))

    def cells(parts: Column, first, second) -> Column:
        numbers = F.when(parts > 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda q: F.struct(F.concat_ws(":", F.hex("cluster"), first(q), second(q)).alias("place"), own.alias("part")))

    here = F.col("level")
    same = cells(F.col("parts"), lambda q: name(here, F.least("part", q)), lambda q: name(here, F.greatest("part", q)))
    above = cells(F.col("above"), lambda q: own, lambda q: name(here + 1, q))
    below = cells(F.col("below"), lambda q: name(here - 1, q), lambda q: own)
    packed = F.array(F.struct(F.concat_ws(":", F.pmod(F.xxhash64("cluster"), F.lit(4 * n)), F.lit("0:0")).alias("place"), F.lit("0").alias("part")))
    joined = members.join(sizes, ["cluster", "level"]).withColumn("part", part)
    return joined.withColumn("cells", F.when(F.col("large"), F.concat(same, above, below)).otherwise(packed)).drop("level", "parts", "below", "above", "large", "part")


class PrefixTree:
    """A trie over sets (each in the order of rare n-grams first) that all probes walk together."""

    def __init__(self, sets: list[np.ndarray], probes: list[np.ndarray], percent: int):
        self.percent = percent
        both = np.concatenate([*sets, *probes])
        values, back, counts = np.unique(both, return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, counts))] = np.arange(len(values))
        ranks, several = rank[back], counts[back] > 1
        lengths = np.array([len(x) for x in [*sets, *probes]])
        ends = np.cumsum(lengths)
        split = lambda i: np.sort(ranks[ends[i] - lengths[i] : ends[i]][several[ends[i] - lengths[i] : ends[i]]])
        self.sizes, self.probe_sizes = lengths[: len(sets)], lengths[len(sets) :]
        self.paths = [split(i) for i in range(len(sets))]
        rows = [split(len(sets) + i) for i in range(len(probes))]
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.begin = np.searchsorted(flat[order], np.arange(len(values) + 1))

    def _overlap(self, tokens: np.ndarray) -> np.ndarray:
        """How many of tokens each probe has."""
        starts, counts = self.begin[tokens], self.begin[tokens + 1] - self.begin[tokens]
        at = np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)
        return np.bincount(self.owner[at], minlength=len(self.probe_sizes))

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """(set, probes that reach the threshold with it), for every set; a probe of the same n-grams counts as one."""
        possible = [i for i, x in enumerate(self.paths) if 100 * len(x) >= self.percent * self.sizes[i]]
        order = sorted(possible, key=lambda i: self.paths[i].astype(">u4").tobytes())
        stack = [(0, len(order), 0, np.zeros(len(self.probe_sizes), np.int64))]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            if lo == hi:
                continue
            inside = order[lo:hi]
            first, last = self.paths[inside[0]], self.paths[inside[-1]]
            most, least = max(len(self.paths[i]) for i in inside), min(self.sizes[i] for i in inside)
            need = -(-self.percent * (least + self.probe_sizes) // (100 + self.percent))
            n = min(len(first), len(last))
            apart = np.flatnonzero(first[depth:n] != last[depth:n])
            end, step, alive = depth + int(apart[0]) if len(apart) else n, max(8, most // 4), True
            while depth < end and alive:
                overlap = overlap + self._overlap(first[depth : min(end, depth + step)])
                depth = min(end, depth + step)
                alive = bool((overlap + (most - depth) >= need).any())
            if not alive:
                continue
            while lo < hi and len(self.paths[order[lo]]) == depth:
                x = order[lo]
                size = self.sizes[x]
                yield x, np.flatnonzero((100 + self.percent) * overlap >= self.percent * (size + self.probe_sizes))
                lo += 1
            while lo < hi:
                token, after = self.paths[order[lo]][depth], lo + 1
                while after < hi and self.paths[order[after]][depth] == token:
                    after += 1
                stack.append((lo, after, depth, overlap))
                lo = after


def join_sets(keys: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], parts: np.ndarray, pair: tuple[str, str], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of one cluster with a link, the smallest member (keys: their order) of its component here, and the weight of its links.

    pair: the two blocks whose members are joined; members of one block are joined with each other where both are equal.
    """
    left, right = np.flatnonzero(parts == pair[0]), np.flatnonzero(parts == pair[1])
    group, found = keys.copy(), np.zeros(len(keys), np.int64)
    if len(left) and len(right):
        tree = PrefixTree([sets[i] for i in left], [sets[i] for i in right], percent)
        for x, near in tree.links():
            me, others = left[x], right[near]
            others = others[keys[others] != keys[me]]
            if not len(others):
                continue
            found[me] += weights[others].sum()
            if pair[0] != pair[1]:
                found[others] += weights[me]
            joined = np.unique(np.append(group[others], group[me]))
            if len(joined) > 1:
                group[np.isin(group, joined)] = joined[0]
    some = np.flatnonzero(found)
    return keys[some], group[some], found[some]


def _cluster_links(table: pa.Table, percent: int) -> pa.Table:
    _, clusters = np.unique(keys_in(table["cluster"]), return_inverse=True)
    names, keys = np.unique(keys_in(table["class"]), return_inverse=True)
    weights, parts = table["weight"].to_numpy(), np.array(table["part"].to_pylist())
    pairs = table["place"].to_pylist()[0].split(":")
    sets = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
    order = np.lexsort((keys, clusters))
    cuts = np.flatnonzero(np.append(True, clusters[order][1:] != clusters[order][:-1]))
    out = [(np.zeros(0, np.int64),) * 3]
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        mine = order[a:b]
        if b - a > 1:
            out.append(join_sets(keys[mine], weights[mine], [sets[i] for i in mine], parts[mine], (pairs[-2], pairs[-1]), percent))
    found, roots, links = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"class": keys_out(names[found]), "root": keys_out(names[roots]), "links": pa.array(links, pa.int64())})


def text_key(text: Column) -> Column:
    """128 bits that stand for a text where ids are missing or repeated."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, keyed: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, n_links; keyed: also text_key, which with the id names the text.

    Texts are lower-cased (A-Z) and cut into words; a text's set is its distinct n-grams of `words` words (a shorter
    text: all its words as one). Rows link when 100 * intersection >= percent * union; component_id is the smallest id
    reachable by links, n_links the number of other rows linked with.

    Null, empty and word-less texts have an empty set, link with nothing and are their own component. Copies, equal sets
    and rows that repeat an id link with each other. Null ids are left out of component_id's minimum. Ids must be
    integers; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    n = buckets(rows)
    sizes, classes = set_classes(rows, words)
    hot, rows_of_hot = hot_grams(rows, words, percent)
    prefixes = rows.mapInArrow(_prefix_rows(n, words, percent, hot), "bucket int, data binary")
    shared = prefixes.groupBy("bucket").applyInArrow(lambda t: _shared_grams(t, n, hot, rows_of_hot), "class binary, data binary")
    shared = shared.groupBy("class").agg(F.collect_list("data").alias("data")).join(classes.select("class", "n_shingles"), "class")
    kept = shared.select("class", "n_shingles", "data").mapInArrow(_kept_grams(n, percent, hot), "bucket int, data binary")
    edges = kept.groupBy("bucket").applyInArrow(lambda t: _stars(t, n), "a binary, b binary")
    out = linked(rows, sizes, classes, edges, n, words, percent, block)
    return out.select(F.col("id").alias(id_col), *(["text_key"] if keyed else []), "n_shingles", "component_id", "n_links")


def set_classes(rows: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text) each one's set size and class, and the classes of sets that are not empty, with their number of
    rows and the row (head, head_key) whose text stands for them."""
    whose = rows.withColumn("text_key", text_key(F.col("text")))
    sizes = written(whose.mapInArrow(_sizes(words), "id long, text_key binary, n_shingles long, class binary"), "sizes")
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "text_key"))
    classes = sizes.filter("n_shingles > 0").groupBy("class", "n_shingles").agg(first.alias("first"), F.count(F.lit(1)).alias("weight"))
    return sizes, classes.select("class", "n_shingles", F.col("first.id").alias("head"), F.col("first.text_key").alias("head_key"), "weight")


def linked(rows: DataFrame, sizes: DataFrame, classes: DataFrame, edges: DataFrame, n: int, words: int, percent: int, block: int) -> DataFrame:
    """id, text_key, n_shingles, component_id and n_links of each row, from candidate edges (a, b) between classes: the full
    sets of each connected group of candidates are joined, so edges need not be links, but must connect all links."""
    whose = rows.withColumn("text_key", text_key(F.col("text")))
    members = connected_components(edges).select(F.col("node").alias("class"), F.col("component").alias("cluster"))
    members = written(members.join(classes, "class"), "members")
    placed = _with_cells(members, n, percent, block)
    found = placed.join(whose.hint("merge"), F.col("head").eqNullSafe(F.col("id")) & (F.col("head_key") == F.col("text_key"))).dropDuplicates(["class"])
    sets = found.select(*_SET, "text").mapInArrow(_full_sets(words), f"{_SET_DDL}, grams binary")
    sets = sets.select("*", F.explode("cells").alias("cell")).select("cell.*", "cluster", "class", "weight", "grams")
    links = written(sets.groupBy("place").applyInArrow(lambda t: _cluster_links(t, percent), "class binary, root binary, links long"), "links")
    degrees = links.groupBy("class").agg(F.sum("links").alias("links"))
    joined = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    heads = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").select("class", "head", "weight", F.coalesce("component", "class").alias("component"))
    least = heads.groupBy("component").agg(F.min("head").alias("component_id"))
    known = heads.join(least, "component").join(degrees, "class", "left").select("class", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sizes.join(known, "class", "left")
    empty = F.col("n_shingles") == 0
    return out.select("id", "text_key", "n_shingles", F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return jaccard_join(read(spark, sf_dir, "documents"))
