"""MinHash near-dedup on fast similarity sketches.

A sketch has SKETCH bins. In each round every n-gram of a set is thrown into one bin by a hash of its own for that round,
and a bin keeps the smallest (round, hash) that it gets; a set is done after the first round that leaves no bin empty.
After as many rounds as there are bins, round SKETCH + i throws all n-grams into bin i, so every bin is filled in the end.
Two sets agree in a bin with the probability of their Jaccard similarity, and the number of bins in which they agree is
as close to its mean as for independent bins, while a set of n costs n hashes and some SKETCH * log(SKETCH), not n for each bin.

Bands of bins are the candidates' keys. Equal keys are joined to a star first where the texts are read, so a key that very
many sets have is one row a task after that, and then by ranges of keys. The full sets of each connected group of
candidates are joined exactly (jaccard.linked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, buckets, read, written
from tidemark.llm._text import mix, pieces
from tidemark.llm.jaccard import BLOCK, CHUNK, KEY, class_keys, keys_in, keys_out, linked, set_classes, shingle_sets

WORDS, PERCENT = 4, 80
#: A pair of similarity s is missed with a probability of (1 - s ** ROWS) ** BANDS: 2.2e-10 at 0.8, 1e-16 at 0.85.
BANDS, ROWS = 56, 5
SKETCH = BANDS * ROWS
#: Hashes, and sets, that are taken at once.
AT_ONCE, SETS = 1 << 18, 2048
_STEP = 0x9E3779B97F4A7C15


def sketches(grams: np.ndarray, bounds: np.ndarray, bins: int = SKETCH) -> np.ndarray:
    """The sketches of sets (one after the other in grams) that are not empty: for each bin the round (upper half) and the
    hash (lower half) of the n-gram that holds it. Rounds are taken for all unfinished sets together, several at a time
    where few n-grams are left: what comes after the round that filled a bin cannot change it."""
    n = len(bounds) - 1
    out = np.full(n * bins, ~np.uint64(0))
    open_, done = np.arange(n), 0
    flat, owner = grams, np.repeat(open_, np.diff(bounds))
    while len(open_):
        rounds = np.arange(done, min(done + max(1, AT_ONCE // max(1, len(flat))), bins if done < bins else 2 * bins))
        hashes = mix(flat[None, :] + (rounds.astype(np.uint64) * np.uint64(2) + np.uint64(1))[:, None] * np.uint64(_STEP))
        if done < bins:
            bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            bin_ = np.broadcast_to((rounds - bins)[:, None], hashes.shape)
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, (owner * bins + bin_).ravel(), value.ravel())
        done += len(rounds)
        open_ = open_[(out.reshape(n, bins)[open_] == ~np.uint64(0)).any(1)]
        still = np.isin(owner, open_)
        flat, owner = flat[still], owner[still]
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of `rows` bins; the keys of different bands differ."""
    parts = sketch.reshape(len(sketch), -1, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return out


def _stars(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the smallest of the numbers that have each, and the distinct pairs of a number and a smaller one
    so found."""
    order = np.lexsort((of, keys))
    keys, of = keys[order], of[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    roots = of[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
    pairs = np.unique(np.stack([of, roots], 1)[of != roots], axis=0).reshape(-1, 2)
    return keys[first], of[first], pairs


def _band_rows(n: int, words: int, bands: int, rows: int):
    """Of each chunk of texts: one row a range of keys (left: the keys, right: a class for each), and one (bucket -1) of
    pairs of classes that share a key in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}

        def pack() -> pa.RecordBatch:
            names = np.array(list(held), KEY)
            keys = np.concatenate([np.zeros((0, bands), np.uint64), *(x[None] for x in held.values())])
            keys, of, pairs = _stars(keys.ravel(), np.repeat(np.arange(len(names)), bands))
            bucket = (keys % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, of, bucket = keys[order], of[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(n + 1))
            out = [(-1, names[pairs[:, 0]].tobytes(), names[pairs[:, 1]].tobytes())]
            out += [(i, keys[a:b].tobytes(), names[of[a:b]].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "left", "right"])

        size = 0
        for piece in pieces(batches):
            grams, bounds = shingle_sets(piece, words)
            classes = class_keys(grams, bounds)
            full = np.diff(bounds) > 0
            where = np.flatnonzero((np.diff(bounds) > 0) & np.array([x not in held for x in classes.tolist()], bool))
            _, first = np.unique(classes[where], return_index=True)
            where = np.sort(where[first])
            for a in range(0, len(where), SETS):
                part = where[a : a + SETS]
                take = np.repeat(np.isin(np.arange(len(piece)), part), np.diff(bounds))
                ends = np.append(0, np.cumsum(np.diff(bounds)[part]))
                found = band_keys(sketches(grams[take], ends, bands * rows), rows)
                held.update(zip(classes[part].tolist(), found, strict=True))
            size += len(piece.data) + 8 * bands * len(where)
            if size >= 2 * CHUNK:
                yield pack()
                size = 0
                held.clear()
        yield pack()

    return run


def _local_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        a, b = (keys_in(rows.column(i)) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([keys_out(a), keys_out(b)], names=["a", "b"])


def _range_pairs(table: pa.Table) -> pa.Table:
    """Joins the classes of each key in one range of keys to the smallest of them."""
    keys = np.frombuffer(b"".join(table["left"].to_pylist()), np.uint64)
    names, of = np.unique(keys_in(table["right"]), return_inverse=True)
    _, _, pairs = _stars(keys, of)
    return pa.table({"a": keys_out(names[pairs[:, 0]]), "b": keys_out(names[pairs[:, 1]])})


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, n_links.

    Texts are lower-cased (A-Z) and cut into words; a text's set is its distinct n-grams of `words` words (a shorter
    text: all its words as one). Sets that share a band of sketch bins are candidates, and all candidates' full sets are
    compared: rows link when 100 * intersection >= percent * union, component_id is the smallest id reachable by links,
    kept says whether that is the row's own, and n_links is the number of other rows linked with. A link is missed only
    where no band agrees and no chain of candidates connects the two (see BANDS); none is ever made up, and no bucket is capped.

    Null, empty and word-less texts have an empty set, link with nothing and are kept. Copies, equal sets and rows that
    repeat an id link with each other; rows that repeat a kept id are kept. Null ids are left out of component_id's
    minimum: a row without an id is kept where no linked one has an id. Ids must be integers; other columns are ignored;
    an empty table gives an empty result.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    n = buckets(given)
    sizes, classes = set_classes(given, words)
    keyed = written(given.mapInArrow(_band_rows(n, words, bands, rows), "bucket int, left binary, right binary"), "bands")
    near = keyed.filter("bucket < 0").select("left", "right").mapInArrow(_local_pairs, "a binary, b binary")
    far = keyed.filter("bucket >= 0").groupBy("bucket").applyInArrow(_range_pairs, "a binary, b binary")
    out = linked(given, sizes, classes, near.union(far), n, words, percent, block)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "n_links")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return minhash_dedup(read(spark, sf_dir, "documents")).drop("n_links")
