"""Vectorised views of texts: UTF-8 bytes of many documents in one buffer, words in it, and their hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Workers are reused for many tasks: arrays of a megabyte and more go back to the system as soon as they are freed.
with contextlib.suppress(OSError, AttributeError):
    for _option in (-1, -3):  # trim and mmap thresholds of glibc
        ctypes.CDLL("libc.so.6").mallopt(_option, 1 << 20)

#: Word separators: space and the control characters 9 to 13.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are taken in pieces of about so many bytes (one longer text is a piece of its own).
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, PIECE + PIECE // 4), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Piece:
    """Some documents: ids, their bytes one after the other in data, and where each begins (bounds, with the end)."""

    def __init__(self, rows: pa.RecordBatch, texts: pa.Array):
        self.rows = rows
        texts = texts if texts.null_count == 0 else texts.fill_null("")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
        self.data = data[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def totals(self, flags: np.ndarray) -> np.ndarray:
        """Sums of flags (one for each byte) by document."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document (its place in the piece) of each word."""
        word = ~IS_SEPARATOR[self.data]
        first = np.zeros(len(word) + 1, bool)
        first[self.bounds] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:-1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return starts, stops, np.searchsorted(self.bounds, starts, "right") - 1

    def sums(self, lower: bool) -> np.ndarray:
        """Running hash sums, for spans()."""
        n = len(self.data)
        out = np.zeros(n + 1, np.uint64)
        codes = _BYTE[LOWER[self.data]] if lower else _BYTE[self.data]
        np.cumsum(codes * powers(_BASE, n), out=out[1:])
        return out

    @staticmethod
    def spans(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte strings from starts to stops."""
        return mix((sums[stops] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE) -> Iterator[Piece]:
    """Cuts record batches into pieces of about limit bytes of text; null texts count as empty."""
    for rows in batches:
        texts = rows.column(rows.schema.get_field_index(text))
        sizes = np.frombuffer(_lengths(texts), np.int64)
        if not len(sizes):
            continue
        turn = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield Piece(rows.slice(a, b - a), texts.slice(a, b - a))


def _lengths(texts: pa.Array) -> bytes:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()


def windows(hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row that belong to one document, and the place of each first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += hashes[j : j + m] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        total = mix(total) if j == n - 1 else total * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(docs[:m] == docs[n - 1 :])
    return total[at], at
