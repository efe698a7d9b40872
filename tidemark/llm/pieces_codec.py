"""SentencePiece encoding and decoding in batches of numpy arrays.

Texts are cut into units that no piece crosses (a run of spaces with what follows up to the next one; control
characters stand alone). Distinct units are gathered by byte length, so that all units of a length advance together;
hashes of their substrings probe the sorted keys of the pieces.

Unigram models are segmented by a Viterbi walk that keeps, for each end, the best score and a back pointer. Models of
merge type (BPE) define their ids by the order of merges instead, which the best sum of scores does not reproduce, so
for these all units of a length take their best merge together, round by round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, read
from tidemark.llm._text import PIECE, Piece, mix, pieces, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
#: Units over so many bytes are merged one by one with a heap.
LONG = 96
#: A task forgets the units it knows when there are more than this.
KNOWN = 2_000_000
_BASE = 0xD1342543DE82EF95 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _hash(data: bytes) -> int:
    x = np.frombuffer(data, np.uint8)
    return int(mix(np.array([(_CODES[x] * powers(_BASE, len(x))).sum(dtype=np.uint64)]))[0])


@dataclass
class Vocabulary:
    """Pieces by sorted hash, their scores, and what each id decodes to."""

    merges: bool
    byte_ids: np.ndarray
    unknown: int
    pieces: dict[bytes, tuple[int, float]]
    decoded: list[bytes]
    keys: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        hashes = np.array([_hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        values = list(self.pieces.values())
        self.ids = np.array([v[0] for v in values], np.int32)[order]
        self.scores = np.array([v[1] for v in values])[order]
        self.longest = max(map(len, self.pieces))
        self.fallback = float(self.scores.min()) - 10.0
        self.sizes = np.array([len(x) for x in self.decoded], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(self.decoded), np.uint8)

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes among the sorted keys, and whether they are there."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes


def load(path: str = MODEL) -> Vocabulary:
    """Reads a SentencePiece model file (normaliser: identity, with a leading space)."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        return parse(sentencepiece_model_pb2.ModelProto.FromString(f.read()))


def parse(model) -> Vocabulary:
    found, decoded, byte_ids, unknown = {}, [], np.full(256, -1, np.int32), 0
    for i, p in enumerate(model.pieces):
        text = b""
        if p.type == p.BYTE:
            text = bytes([int(p.piece[3:5], 16)])
            byte_ids[text[0]] = i
        elif p.type in (p.NORMAL, p.USER_DEFINED):
            found[p.piece.encode()] = (i, p.score)
            text = p.piece.encode().replace(SPACE, b" ")
        elif p.type == p.UNKNOWN:
            unknown = i
        decoded.append(text)
    return Vocabulary(model.trainer_spec.model_type == model.trainer_spec.BPE, byte_ids, unknown, found, decoded)


def _spans(rows: np.ndarray) -> np.ndarray:
    """Running hash sums of each row of bytes."""
    n = rows.shape[1]
    out = np.zeros((len(rows), n + 1), np.uint64)
    np.cumsum(_CODES[rows] * powers(_BASE, n), axis=1, out=out[:, 1:])
    return out


def _char_starts(rows: np.ndarray) -> np.ndarray:
    return (rows & 0xC0) != 0x80


def viterbi(v: Vocabulary, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of units of one length (one a row): starts of its pieces as flags, and the id that starts
    there (-1: a character to be spelt in bytes)."""
    m, n = rows.shape
    sums, start = _spans(rows), _char_starts(rows)
    inverse = powers(_INVERSE, n + 1)
    best = np.full((m, n + 1), -np.inf)
    best[:, 0] = 0
    back, ids = np.zeros((m, n + 1), np.int64), np.full((m, n + 1), -1, np.int64)
    for end in range(1, n + 1):
        boundary = start[:, end] if end < n else np.ones(m, bool)
        for size in range(1, min(end, max(v.longest, 4)) + 1):
            a = end - size
            here = np.flatnonzero(boundary & start[:, a] & (best[:, a] > -np.inf))
            if not len(here):
                continue
            at, hit = v.probe(mix((sums[here, end] - sums[here, a]) * inverse[a]))
            single = start[here, a:end].sum(1) == 1
            score = np.where(hit, v.scores[at], np.where(single, v.fallback, -np.inf)) + best[here, a]
            better = score > best[here, end]
            rows_, at, hit = here[better], at[better], hit[better]
            best[rows_, end], back[rows_, end] = score[better], a
            ids[rows_, end] = np.where(hit, v.ids[at], -1)
    flags, out = np.zeros((m, n), bool), np.full((m, n), -1, np.int64)
    end = np.full(m, n)
    while (live := np.flatnonzero(end > 0)).size:
        a = back[live, end[live]]
        flags[live, a], out[live, a] = True, ids[live, end[live]]
        end[live] = a
    return flags, out


def merge(v: Vocabulary, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merges of units of one length: each row takes its best-scored merge (the leftmost of equals) until none is
    left. Returns as viterbi()."""
    m, n = rows.shape
    sums, inverse = _spans(rows), powers(_INVERSE, n + 1)
    start = _char_starts(rows)
    count = start.sum(1)
    width = int(count.max())
    order = np.argsort(~start, axis=1, kind="stable")
    places = np.full((m, width + 2), n, np.int64)
    places[:, :width] = np.where(np.arange(width) < count[:, None], order[:, :width], n)

    def scores(who: np.ndarray, i: np.ndarray) -> np.ndarray:
        a, mid, b = places[who, i], places[who, i + 1], places[who, i + 2]
        at, hit = v.probe(mix((sums[who, b] - sums[who, a]) * inverse[np.minimum(a, n)]))
        return np.where(hit & (mid < n), v.scores[at], -np.inf)

    who = np.arange(m)
    pair = np.full((m, width + 1), -np.inf)
    for i in range(width - 1):
        pair[:, i] = scores(who, np.full(m, i))
    columns = np.arange(width + 2)
    while len(who):
        best = pair[who].argmax(1)
        going = pair[who, best] > -np.inf
        who, best = who[going], best[going]
        if not len(who):
            break
        moved = np.minimum(columns + (columns > best[:, None]), width + 1)
        places[who] = np.take_along_axis(places[who], moved, 1)
        moved = np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), width)
        pair[who] = np.take_along_axis(pair[who], moved, 1)
        pair[who, width] = -np.inf
        pair[who, best] = scores(who, best)
        left = best > 0
        pair[who[left], best[left] - 1] = scores(who[left], best[left] - 1)
    flags, out = np.zeros((m, n), bool), np.full((m, n), -1, np.int64)
    for i in range(width):
        a, b = places[:, i], places[:, i + 1]
        here = np.flatnonzero(a < n)
        at, hit = v.probe(mix((sums[here, b[here]] - sums[here, a[here]]) * inverse[a[here]]))
        flags[here, a[here]], out[here, a[here]] = True, np.where(hit, v.ids[at], -1)
    return flags, out


def merge_long(v: Vocabulary, unit: bytes) -> list[int]:
    """The merges of one long unit, with a heap of candidates."""
    chars = [c.encode() for c in unit.decode()]
    n = len(chars)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (p := v.pieces.get(joined := chars[i] + chars[j])):
            heapq.heappush(heap, (-p[1], i, j, joined))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        if not chars[i] or not chars[j] or after[i] != j or chars[i] + chars[j] != joined:
            continue
        chars[i], chars[j] = joined, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out: list[int] = []
    for c in filter(None, chars):
        out += [v.pieces[c][0]] if c in v.pieces else [int(x) if x >= 0 else v.unknown for x in v.byte_ids[list(c)]]
    return out


def _spell(v: Vocabulary, rows: np.ndarray, flags: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each row one after the other, and how many: pieces, and characters without one in bytes."""
    loose = flags & (ids < 0)
    if loose.any():
        n = rows.shape[1]
        since = np.maximum.accumulate(np.where(flags, np.arange(n), 0), axis=1)
        spelt = np.take_along_axis(loose, since, 1)
        ids = np.where(spelt, np.where(v.byte_ids[rows] >= 0, v.byte_ids[rows], v.unknown), ids)
        flags = flags | spelt
    return ids[flags].astype(np.int32), flags.sum(1)


def encode_units(v: Vocabulary, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units (byte ranges of data) one after the other, and how many each has."""
    sizes = stops - starts
    counts, parts = np.zeros(len(starts), np.int64), []
    step = merge if v.merges else viterbi
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        if size > LONG and v.merges:
            found = [merge_long(v, data[starts[i] : starts[i] + size].tobytes()) for i in mine]
            counts[mine] = [len(x) for x in found]
            parts.append((mine, np.array([y for x in found for y in x], np.int32)))
            continue
        limit = max(1, (1 << 20) // size)
        for at in range(0, len(mine), limit):
            some = mine[at : at + limit]
            rows = data[starts[some][:, None] + np.arange(size)]
            ids, counts[some] = _spell(v, rows, *step(v, rows))
            parts.append((some, ids))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(offsets[-1], np.int32)
    for some, ids in parts:
        out[_ranges(offsets[some], counts[some])] = ids
    return out, counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class Encoder:
    """Encodes pieces of a record batch; remembers the units it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def spaced(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with U+2581 for each space and before each text that is not empty; where each text begins."""
        full = np.diff(piece.bounds) > 0
        wide = np.where(piece.data == 32, 3, 1)
        head = np.zeros(len(piece.data), np.int64)
        head[piece.bounds[:-1][full]] = 3
        data = np.repeat(piece.data, wide + head)
        first = np.cumsum(wide + head) - wide - head
        for at in (first[head > 0], (first + head)[wide == 3]):
            for j in range(3):
                data[at + j] = SPACE[j]
        return data, np.concatenate([[0], np.cumsum(wide + head)])[piece.bounds]

    @staticmethod
    def units(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the units begin."""
        space = np.zeros(len(data) + 1, bool)
        space[: max(0, len(data) - 2)] = (data[:-2] == SPACE[0]) & (data[1:-1] == SPACE[1]) & (data[2:] == SPACE[2])
        begins = space[:-1].copy()
        begins[3:] &= ~space[:-1][:-3]
        control = data < 32
        begins |= control
        begins[1:] |= control[:-1]
        inside = bounds[(bounds < len(data))]
        begins[inside] = True
        return np.flatnonzero(begins)

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        data, bounds = self.spaced(piece)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(piece) + 1, np.int64)
        starts = self.units(data, bounds)
        stops = np.append(starts[1:], len(data))
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * powers(_BASE, n), out=sums[1:])
        hashes = mix((sums[stops] - sums[starts]) * powers(_INVERSE, n + 1)[starts] + (stops - starts).astype(np.uint64))
        units, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > KNOWN:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, units), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != units if len(self.hashes) else np.ones(len(units), bool)
        if new.any():
            ids, counts = encode_units(self.v, data, starts[first[new]], stops[first[new]])
            order = np.argsort(all_ := np.concatenate([self.hashes, units[new]]))
            self.hashes = all_[order]
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
            self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, units)[back]
        counts = self.counts[at]
        ids = self.ids[_ranges(self.starts[at], counts)]
        totals = np.concatenate([[0], np.cumsum(counts)])
        return ids, totals[np.searchsorted(starts, bounds)]


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each text begins; the leading space of each is dropped."""
    sizes = v.sizes[ids]
    data = v.bytes[_ranges(v.offsets[ids], sizes)]
    places = np.concatenate([[0], np.cumsum(sizes)])[bounds]
    full = places[1:] > places[:-1]
    drop = np.zeros(len(data), bool)
    drop[places[:-1][full]] = data[places[:-1][full]] == 32
    return data[~drop], places - np.concatenate([[0], np.cumsum(drop)])[places]


def _ids_column(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


def piece_encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids (as the model's own encoder gives them), n_pieces, round_trip (decoding gives the
    text again, byte by byte).

    Null and empty texts have no pieces. A text with U+2581 in it decodes to spaces there, so round_trip is false.
    model: a SentencePiece file that every worker can read. Other columns are ignored; null ids and repeated rows are
    encoded like any other; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(model))
        for piece in pieces(batches, limit=2 * PIECE):
            ids, bounds = encoder.encode(piece)
            data, places = decode(encoder.v, ids, bounds)
            same = np.diff(places) == np.diff(piece.bounds)
            if len(data) == len(piece.data):
                wrong = np.concatenate([[0], np.cumsum(data != piece.data)])
                same &= wrong[piece.bounds[1:]] == wrong[piece.bounds[:-1]]
            else:
                same &= [data[a:b].tobytes() == piece.data[c:d].tobytes() for a, b, c, d in zip(places[:-1], places[1:], piece.bounds[:-1], piece.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), _ids_column(ids, bounds), pa.array(np.diff(bounds), pa.int64()), pa.array(same)], names=["id", "ids", "n_pieces", "round_trip"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, n_pieces long, round_trip boolean").withColumnRenamed("id", id_col)


def piece_decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: id and text. Null ids give an empty text; bytes that are no UTF-8 become U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for rows in batches:
            lists = [np.array(x or [], np.int64) for x in rows.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            data, places = decode(v, np.concatenate([np.zeros(0, np.int64), *lists]), bounds)
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return piece_encode(read(spark, sf_dir, "documents"))
