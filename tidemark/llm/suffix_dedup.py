"""Removal of passages that occur earlier, by a sparse, distributed suffix array with deep-shallow sorting.

Every string of `length` bytes is filed under its anchor: the leftmost smallest hash among the strings of ANCHOR bytes
in it. Equal strings have equal anchors, and neighbouring strings mostly share one, so a run of strings with one
anchor travels as one segment. Anchors that occur once in the corpus are dropped first, as hashes only; what is left
is dealt by anchor, and each task sorts its suffixes and marks all but the first of those that agree in `length`
bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, buckets, read
from tidemark.llm._text import Piece, pieces

LENGTH = 100
ANCHOR = 32
#: Suffixes are sorted by this many first bytes, eight at a time; longer common prefixes go to blind tries.
SHALLOW = 32
#: A task packs its rows whenever it has taken in so many bytes of text.
CHUNK = 32 << 20

_SEGMENT = np.dtype([("hash", "<u8"), ("id", "<i8"), ("sig", "<i8"), ("start", "<u4"), ("count", "u1"), ("shift", "u1"), ("known", "u1")])
_RUN = np.dtype([("start", "<u4"), ("count", "u1"), ("shift", "u1")])
_SPAN = np.dtype([("start", "<u4"), ("count", "<u4")])


def _doc_key(id_col: str, text_col: str) -> list:
    """The columns that the steps share: id, sig (which tells apart texts that repeat an id) and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.sha2(text, 256)).alias("sig"), text.alias("text")]


def anchored_runs(piece: Piece, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one anchor: document, first start, number of strings, place of the anchor after
    the first start, hash of the anchor."""
    n, wide = len(piece.data), length - anchor + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    sums = piece.sums(lower=False)
    places = np.arange(n - anchor + 1)
    hashes = Piece.spans(sums, places, places + anchor)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    span = 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(at))
    docs = np.repeat(np.arange(len(piece)), np.diff(piece.bounds))[: len(at)]
    inside = starts + length <= piece.bounds[docs + 1]
    starts, at, docs = starts[inside], at[inside], docs[inside]
    if not len(starts):
        return starts, starts, starts, starts, np.zeros(0, np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (docs[1:] != docs[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(starts)))
    return docs[heads], starts[heads] - piece.bounds[docs[heads]], counts, at[heads] - starts[heads], hashes[at[heads]]


def _encoded(rows: np.ndarray) -> bytes:
    """Segments by document: each document once, with the number of its rows; six bytes of each hash."""
    rows = rows[np.lexsort((rows["sig"], rows["id"]))]
    heads = np.flatnonzero(np.append(True, (rows["id"][1:] != rows["id"][:-1]) | (rows["sig"][1:] != rows["sig"][:-1])))
    counts = np.diff(np.append(heads, len(rows))).astype("<u4")
    hashes = np.ascontiguousarray(rows["hash"]).view(np.uint8).reshape(-1, 8)[:, :6]
    flags = rows["shift"] | (rows["known"] << 7)
    return np.array([len(heads), len(rows)], "<u8").tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in (rows["id"][heads], rows["sig"][heads], counts, hashes, rows["start"], rows["count"], flags))


def _decoded(data: bytes) -> np.ndarray:
    k, n = (int(x) for x in np.frombuffer(data, "<u8", 2))
    rows, at = np.zeros(n, _SEGMENT), 16
    ids, sigs, counts = np.frombuffer(data, "<i8", k, at), np.frombuffer(data, "<i8", k, at + 8 * k), np.frombuffer(data, "<u4", k, at + 16 * k)
    rows["id"], rows["sig"] = np.repeat(ids, counts), np.repeat(sigs, counts)
    at += 20 * k
    hashes = np.zeros((n, 8), np.uint8)
    hashes[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(-1, 6)
    rows["hash"] = hashes.view("<u8").reshape(-1)
    at += 6 * n
    rows["start"] = np.frombuffer(data, "<u4", n, at)
    rows["count"] = np.frombuffer(data, np.uint8, n, at + 4 * n)
    flags = np.frombuffer(data, np.uint8, n, at + 5 * n)
    rows["shift"], rows["known"] = flags & 127, flags >> 7
    return rows


def _dealt(keys: np.ndarray, rows: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield int(keys[a]), kind, _encoded(rows[a:b]) if rows.dtype == _SEGMENT else rows[a:b].tobytes()


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "data"])


def _anchor_rows(n: int, length: int):
    """Segments of each task, packed by hash range. Of an anchor that a task meets often only one goes to the anchor's
    range; the others, known to repeat, are dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pack() -> pa.RecordBatch:
            rows = np.concatenate(held)
            if not len(rows):
                return _packed([])
            rows = rows[np.argsort(rows["hash"], kind="stable")]
            same = rows["hash"][1:] == rows["hash"][:-1]
            rows["known"] = np.append(same, False) | np.append(False, same)
            first = np.append(True, ~same)
            once, more = rows[first], rows[~first]
            return _packed([*_dealt((once["hash"] % np.uint64(n)).astype(np.int64), once, 0), *_dealt(np.arange(len(more)) * n // max(1, len(more)), more, 1)])

        size = 0
        for piece in pieces(batches):
            docs, starts, counts, shifts, hashes = anchored_runs(piece, length)
            rows = np.zeros(len(docs), _SEGMENT)
            rows["hash"], rows["start"], rows["count"], rows["shift"] = hashes, starts, counts, shifts
            rows["id"] = piece.rows.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()[docs]
            rows["sig"] = piece.rows.column(1).to_numpy()[docs]
            held.append(rows)
            size += len(piece.data)
            if size >= CHUNK:
                yield pack()
                held, size = [], 0
        if held:
            yield pack()

    return run


def _by_doc(ids: np.ndarray, sigs: np.ndarray, rows: np.ndarray) -> pa.Table:
    """Packs rows into one value for each document."""
    order = np.lexsort((rows["start"], sigs, ids))
    ids, sigs, rows = ids[order], sigs[order], rows[order]
    cuts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (sigs[1:] != sigs[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(ids)).astype(np.int64)[: len(cuts)]
    return pa.table({"id": pa.array(ids[cuts], pa.int64()), "sig": pa.array(sigs[cuts], pa.int64()), "data": pa.array([rows[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})


def _repeated_anchors(table: pa.Table) -> pa.Table:
    """Keeps the segments whose anchor occurs more than once."""
    kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
    once = np.concatenate([np.zeros(0, _SEGMENT), *(_decoded(x) for x, k in zip(data, kinds, strict=True) if k == 0)])
    hashes, back, counts = np.unique(once["hash"], return_inverse=True, return_counts=True)
    known = np.bincount(back, once["known"], minlength=len(hashes)) > 0
    kept = np.concatenate([once[(counts[back] > 1) | known[back]], *(_decoded(x) for x, k in zip(data, kinds, strict=True) if k == 1)])
    runs = np.zeros(len(kept), _RUN)
    for k in _RUN.names:
        runs[k] = kept[k]
    return _by_doc(kept["id"], kept["sig"], runs)


class _Segments:
    """Distinct segments with the first place of each; spans that turn out to be copies."""

    def __init__(self) -> None:
        self.first: dict[bytes, tuple[int, int, int, int, int]] = {}
        self.size = 0
        self.copies: list[tuple[int, int, int, int]] = []

    def add(self, body: bytes, place: tuple[int, int, int, int, int]) -> None:
        """place: id, sig, start, number of strings, place of the anchor."""
        old = self.first.setdefault(body, place)
        if old is place:
            self.size += len(body) + 200
        elif place[:3] < old[:3]:
            self.first[body] = place
            self.copies.append(old[:4])
        elif place[:3] != old[:3]:
            self.copies.append(place[:4])


_PLACE = np.dtype([("id", "<i8"), ("sig", "<i8"), ("start", "<u4"), ("count", "<u4"), ("shift", "<u4")])
_COPY = np.dtype([("id", "<i8"), ("sig", "<i8"), ("start", "<u4"), ("count", "<u4")])


def _segment_rows(n: int, length: int, anchor: int = ANCHOR):
    """Cuts the segments out of the texts; equal ones collapse in the task, and the rest is packed by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            by: dict[int, list] = {}
            for body, place in held.first.items():
                by.setdefault(xxhash.xxh3_64_intdigest(body[place[4] : place[4] + anchor]) % n, []).append((body, place))
            out = []
            for key, items in by.items():
                places = np.array([p for _, p in items], _PLACE)
                out.append((key, 0, places.tobytes() + b"".join(b for b, _ in items)))
            copies = np.array(held.copies, _COPY)
            return _packed_places([(k, len(by[k]), d) for k, _, d in out], copies, n)

        held = _Segments()
        for rows in batches:
            for id_, sig, text, data in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                body = text.encode()
                for start, count, shift in np.concatenate([np.frombuffer(x, _RUN) for x in data]).tolist():
                    held.add(body[start : start + count - 1 + length], (id_, sig, start, count, shift))
                if held.size >= CHUNK or len(held.copies) >= CHUNK // 64:
                    yield pack()
                    held = _Segments()
        yield pack()

    return run


def _packed_places(out: list[tuple[int, int, bytes]], copies: np.ndarray, n: int) -> pa.RecordBatch:
    rows = [(k, count, d) for k, count, d in out]
    rows += [(k, -1, d) for k, _, d in _dealt(np.arange(len(copies)) * n // max(1, len(copies)), copies, 1)]
    return _packed(rows)


def _words_at(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a big-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of data at starts by their first `length` bytes, and for each in that order whether it
    agrees with the one before it in all of them. data must reach `length` bytes past each start.

    Multikey quicksort, on eight bytes at a time, goes down to the shallow depth; each group that is still together is
    then ordered by a blind trie.
    """
    words = _words_at(data)
    order, m = np.arange(len(starts)), len(starts)
    heads, equal = np.zeros(m, bool), np.zeros(m, bool)
    heads[:1] = True
    multikey_quicksort(words, starts, length, min(shallow, length), order, heads)
    if shallow >= length:
        return order, ~heads
    open_ = np.flatnonzero(~(heads & np.append(heads[1:], True)))
    known = np.full(len(open_), shallow)
    while len(open_):
        open_, known = _grow_tries(data, words, starts, length, order, heads, equal, open_, known)
    return order, equal


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, length: int, limit: int, order: np.ndarray, heads: np.ndarray) -> None:
    """Orders the suffixes at starts by their first `limit` bytes, of which `length` count; heads marks where those change.

    All groups that are open are parted at once, each in three by a pivot, the median of its first, middle and last key:
    smaller and larger keys are parted again at the same depth, equal ones eight bytes further on.
    """
    at, first, depth = np.arange(len(order)), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(at) > 1:
        sizes = np.diff(np.append(first, len(at)))
        of = np.repeat(np.arange(len(first)), sizes)
        beyond = (8 * np.clip(depth + 8 - length, 0, 7)).astype(np.uint64)
        keys = words[starts[order[at]] + depth[of]] >> beyond[of]
        a, b, c = keys[first], keys[first + sizes // 2], keys[first + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[of]
        side = 1 + (keys > pivot).astype(np.int64) - (keys < pivot)
        counts = np.bincount(3 * of + side, minlength=3 * len(first))
        begin = np.cumsum(counts) - counts
        to = np.empty(len(at), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            before = np.cumsum(counts[k::3]) - counts[k::3]
            to[mine] = begin[k::3][of[mine]] + np.arange(len(mine)) - before[of[mine]]
        moved = np.empty_like(at)
        moved[to] = order[at]
        order[at] = moved
        heads[at[begin[counts > 0]]] = True
        deeper = (depth[:, None] + np.array([0, 8, 0])).reshape(-1)
        kept = (counts > 1) & (deeper < limit)
        at = at[np.repeat(kept, counts)]
        depth, sizes = deeper[kept], counts[kept]
        first = np.cumsum(sizes) - sizes


def _grow_tries(data, words, starts, length, order, heads, equal, open_, known) -> tuple[np.ndarray, np.ndarray]:
    """One level of all blind tries at once. The first suffix of each group is its trie's path; each other one is compared
    with it once, from the depth that the group is known to share, and hangs where it leaves the path, placed by branch
    depth and branching byte alone. Those that hang together form the groups of the next level, known to share one byte
    more than that depth; those that follow the path to the end are equal to it."""
    group = np.cumsum(heads)[open_]
    first = np.append(True, group[1:] != group[:-1])
    mine = starts[order[open_]]
    path = mine[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
    common = np.full(len(open_), length, np.int64)
    depth, going = known.copy(), np.flatnonzero(~first & (known < length))
    while len(going):
        differ = words[mine[going] + depth[going]] ^ words[path[going] + depth[going]]
        apart = differ != 0
        at, x = going[apart], differ[apart]
        lead = np.zeros(len(at), np.int64)
        for step in (32, 16, 8):
            clear = x >> np.uint64(64 - step) == 0
            lead += np.where(clear, step // 8, 0)
            x = np.where(clear, x << np.uint64(step), x)
        common[at] = np.minimum(depth[at] + lead, length)
        going = going[~apart]
        depth[going] += 8
        going = going[depth[going] < length]
    off = common < length
    byte = np.where(off, data[mine + np.minimum(common, length - 1)], 0).astype(np.int64)
    own = np.where(off, data[path + np.minimum(common, length - 1)], 0).astype(np.int64)
    below = off & (byte < own)
    side = np.where(off, np.where(below, -1, 1), 0)
    turn = np.lexsort((byte, np.where(below, common, -common), side, group))
    order[open_] = order[open_][turn]
    group, side, common, byte = group[turn], side[turn], common[turn], byte[turn]
    new = np.append(True, (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (common[1:] != common[:-1]) | (byte[1:] != byte[:-1]))
    heads[open_] = new
    on_path = side == 0
    equal[open_[on_path & ~new]] = True
    hanging = np.append(new[1:], True)
    more = ~on_path & ~(new & hanging)
    return open_[more], common[more] + 1


def _marked(table: pa.Table, length: int, shallow: int) -> pa.Table:
    """Spans of strings that start earlier elsewhere, by document."""
    held = _Segments()
    copies = [np.zeros(0, _COPY)]
    for count, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
        if count < 0:
            copies.append(np.frombuffer(data, _COPY))
            continue
        places, at = np.frombuffer(data, _PLACE, count), count * _PLACE.itemsize
        for place in places.tolist():
            size = place[3] - 1 + length
            held.add(data[at : at + size], place)
            at += size
    copies.append(np.array(held.copies, _COPY))
    by: dict[bytes, list] = {}
    for body, place in held.first.items():
        by.setdefault(body[place[4] : place[4] + ANCHOR], []).append((body, place))
    mixed = [x for items in by.values() if len(items) > 1 for x in items]
    if mixed:
        data = np.frombuffer(b"".join(b for b, _ in mixed) + bytes(length), np.uint8)
        places = np.array([p for _, p in mixed], _PLACE)
        sizes = places["count"].astype(np.int64) - 1 + length
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        of = np.repeat(np.arange(len(places)), places["count"])
        within = np.arange(len(of)) - np.repeat(np.cumsum(places["count"].astype(np.int64)) - places["count"], places["count"])
        order, equal = deep_shallow_sort(data, begins[of] + within, length, shallow)
        group = np.cumsum(~equal)
        shared = np.append(equal[1:], False) | equal
        order, group = order[shared], group[shared]
        ids, sigs, at = places["id"][of[order]], places["sig"][of[order]], places["start"][of[order]] + within[order]
        turn = np.lexsort((at, sigs, ids, group))
        late = np.append(False, group[turn][1:] == group[turn][:-1]) if len(turn) else np.zeros(0, bool)
        found = np.zeros(int(late.sum()), _COPY)
        found["id"], found["sig"], found["start"], found["count"] = ids[turn][late], sigs[turn][late], at[turn][late], 1
        copies.append(found)
    rows = np.concatenate(copies)
    rows = rows[np.lexsort((rows["start"], rows["sig"], rows["id"]))]
    if len(rows):
        ends = rows["start"].astype(np.int64) + rows["count"]
        new = np.append(True, (rows["id"][1:] != rows["id"][:-1]) | (rows["sig"][1:] != rows["sig"][:-1]) | (rows["start"][1:] > ends[:-1]))
        heads = np.flatnonzero(new)
        tops = np.maximum.reduceat(ends, heads)
        rows = rows[heads]
        rows["count"] = tops - rows["start"]
    spans = np.zeros(len(rows), _SPAN)
    spans["start"], spans["count"] = rows["start"], rows["count"]
    return _by_doc(rows["id"], rows["sig"], spans)


def removed_spans(text: bytes, data: list[bytes] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs [start, end) of bytes under any marked string."""
    marks = np.concatenate([np.frombuffer(x, _SPAN) for x in data]) if data else np.zeros(0, _SPAN)
    out: list[tuple[int, int]] = []
    for start, count in np.sort(marks).tolist():
        end = start + count - 1 + length
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for text, data in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                body = text.encode()
                spans = removed_spans(body, data, length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(body[at:a])
                    at = b
                kept = b"".join([*kept, body[at:]])
                out.append((len(body), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None, [{"start": a, "end": b} for a, b in spans] if texts else None))
            arrays = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(arrays if texts else arrays[:4])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 7 if texts else 5])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shallow: int = SHALLOW, with_texts: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and, with_texts, the kept bytes and the
    removed spans (byte offsets).

    Texts are UTF-8 bytes. A byte goes when a string of `length` bytes over it also starts earlier: in a document of
    smaller id, or earlier in its own. All strings are judged on the input; matches never cross documents.

    Null text counts as empty. Texts under `length` bytes lose nothing. Null ids come before all others. Rows that
    repeat an id with the same text are one document (each gives the same result); with another text they are ordered
    by a hash of the text. Ids must be integers. Other columns are ignored; an empty table gives an empty result.
    length must be over ANCHOR and at most 127 + ANCHOR; cutting bytes may split a character, hence kept is binary.
    """
    spark = docs.sparkSession
    parts = buckets(docs, text_col)
    n, ranges = parts * 2, max(8, parts // 2)
    rows = docs.select(*_doc_key(id_col, text_col))
    dealt = rows.mapInArrow(_anchor_rows(ranges, length), "bucket int, kind int, data binary")
    runs = dealt.groupBy("bucket").applyInArrow(_repeated_anchors, "id long, sig long, data binary")
    runs = runs.groupBy("id", "sig").agg(F.collect_list("data").alias("data"))
    least = F.lit(np.iinfo(np.int64).min)
    texts = rows.select(F.coalesce("id", least).alias("id"), "sig", "text").repartition(parts, "id", "sig")
    with_runs = texts.join(runs.hint("merge"), ["id", "sig"])
    segments = with_runs.select("id", "sig", "text", "data").mapInArrow(_segment_rows(n, length), "bucket int, kind int, data binary")
    spans = segments.groupBy("bucket").applyInArrow(lambda t: _marked(t, length, shallow), "id long, sig long, data binary")
    spans = spans.groupBy("id", "sig").agg(F.collect_list("data").alias("data"))
    full = texts.join(spans.hint("merge"), ["id", "sig"], "left").select(F.expr(f"nullif(id, {np.iinfo(np.int64).min})").alias("id"), "text", "data")
    more = ", kept binary, spans array<struct<start:long,end:long>>" if with_texts else ""
    return full.mapInArrow(_cut(length, with_texts), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more).withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return suffix_dedup(read(spark, sf_dir, "documents"), with_texts=False)
