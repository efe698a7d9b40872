"""WARC archives: written as whole-file gzip streams, normalised to one member per record, read through an offset index."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, fresh, read, written

#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 1000
#: An archive is closed after so many payload bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 1
_STEP = 1 << 18
_ENTRY = struct.Struct("<QQ")


def classify(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, digest, size, kind, refers_to) for each row: of equal payloads the largest id is the response."""
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    ids = pages.select(F.col(id_col).alias("id"), F.sha1(body).alias("digest"), F.sha2(body, 256).alias("strong"), F.octet_length(body).cast("bigint").alias("size"))
    groups = ids.filter(F.col("size") >= min_bytes).groupBy("digest", "strong", "size").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = ids.join(groups, ["digest", "strong", "size"], "left")
    revisit = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    return joined.select("id", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("head")).alias("refers_to"))


def _uri(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " ")


def _record(page_id, url, html, digest, size, kind, refers) -> bytes:
    body = (html or "").encode() if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_uri(url)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _writer(folder: str):
    """Writes the rows of a partition to archives, each one gzip stream; a retried task writes new files, and only
    files named in the returned rows are read later."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, done = None, []

        def close() -> None:
            nonlocal out
            if out:
                out.write(packer.flush())
                out.close()
                done.append((f"{folder}/{name}", n))
            out = None

        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if out is None:
                    name, n, filled = f"crawl-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = _record(*row)
                out.write(packer.compress(data))
                n, filled = n + 1, filled + len(data)
                if filled >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return write


def _inflated(stream) -> Iterator[bytes]:
    """The records of a whole-file gzip stream (of one member or several), inflated once, in bounded memory."""
    unpack, held = zlib.decompressobj(31), bytearray()
    ended = False
    while True:
        cut = held.find(b"\r\n\r\n")
        need = -1
        if cut >= 0:
            size = next((int(x.split(b":")[1]) for x in bytes(held[:cut]).split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
            need = cut + 4 + size + 4
        if 0 <= need <= len(held):
            yield bytes(held[:need])
            del held[:need]
            continue
        if ended:
            if bytes(held).strip():
                raise ValueError("archive ends inside a record")
            return
        data = stream.read(_STEP)
        ended = not data
        while data:
            held += unpack.decompress(data)
            data = unpack.unused_data
            if data:
                unpack = zlib.decompressobj(31)


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        done = []
        for path in rows.column(0).to_pylist():
            store, at = _store(path)
            stem = f"{path.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
            to, n, offset = _store(f"{stem}.members.warc.gz")[1], 0, 0
            with store.open_input_stream(at, compression=None) as source, store.open_output_stream(to, compression=None) as out, store.open_output_stream(_store(f"{stem}.idx")[1], compression=None) as index:
                for record in _inflated(source):
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    out.write(member)
                    index.write(_ENTRY.pack(offset, len(member)))
                    n, offset = n + 1, offset + len(member)
            done.append((f"{stem}.members.warc.gz", f"{stem}.idx", n))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "index", "records"])


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields | {"payload": rest[: int(fields["Content-Length"])]}


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("intact", pa.bool_()), ("archive", pa.string()), ("offset", pa.int64())])
    for rows in batches:
        for path, index in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            store, at = _store(path)
            with store.open_input_stream(_store(index)[1], compression=None) as f:
                entries = list(_ENTRY.iter_unpack(f.read()))
            found: list[tuple] = []
            with store.open_input_file(at) as source:
                for offset, size in entries:
                    source.seek(offset)
                    x = parse(zlib.decompress(source.read(size), 31))
                    kind, digest = x["WARC-Type"], x["WARC-Payload-Digest"].removeprefix("sha1:")
                    intact = kind == "revisit" or hashlib.sha1(x["payload"]).hexdigest() == digest
                    refers = x.get("WARC-Refers-To")
                    found.append((x["WARC-Record-ID"][10:-1], x.get("WARC-Target-URI", ""), int(x["WARC-Payload-Length"]), digest, kind, refers and refers[10:-1], intact, path, offset))
                    if len(found) == 2000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema)
                        found = []
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes one WARC record per row to archives that are single gzip streams; returns (path, records).

    Null html is an empty payload, null url an empty one. Of equal payloads of at least min_bytes the row with the
    largest id is a response, the others revisit it. Rows that repeat an id with equal html are all that id's kind. An
    empty table gives no archives.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = classify(rows, "id", "html", min_bytes).distinct()
    digest = F.sha1(F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")).alias("digest")
    full = rows.select("*", digest).alias("r").join(kinds.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.digest") == F.col("k.digest")))
    full = full.select("r.id", "r.url", "r.html", "k.digest", "k.size", "k.kind", "k.refers_to")
    return written(full.mapInArrow(_writer(fresh(spark, "warc")), "path string, records long"), "archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Inflates each whole-file stream once, rewrites every record as its own gzip member beside a sidecar index of
    (offset, length); returns (path, index, records). Archives spread over tasks by their path."""
    spread = archives.repartition(archives.sparkSession.sparkContext.defaultParallelism * 4, "path").select("path")
    return written(spread.mapInArrow(_normalise, "path string, index string, records long"), "members")


def read_archives(members: DataFrame) -> DataFrame:
    """One row per record, read member by member through the sidecar index; intact: the payload has its digest."""
    spread = members.repartition(members.sparkSession.sparkContext.defaultParallelism * 4, "path").select("path", "index")
    return spread.mapInArrow(_reader, "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean, archive string, offset long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 200)
    records = read_archives(normalise_archives(write_archives(read(spark, sf_dir, "pages"))))
    return records.select(F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS bigint)").alias("refers_to"), "intact")


OP7_SQL = f"""
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS head FROM t)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> head THEN head END AS refers_to, true AS intact
FROM g
"""
