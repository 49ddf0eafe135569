"""WARC archives: written with an index, read back by coalesced byte ranges.

The payload digest of each page decides first which record of equal payloads is
the response; the others become revisits that name it. Tasks write archive
files to the shared folder and return the index: file, offset, length, URL and
digest of each record. Reading goes by the index: the selected entries are
sorted by file and offset, neighbouring byte ranges are read at once, and the
records parsed and checked against their digest. Each record is a gzip member of
its own, as WARC readers expect, so that it can be read alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import materialize, new_folder, parts

INDEX = "file string, offset long, length long, url string, digest string"
RECORD = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long"
)

KINDS = {
    "page_id": pa.int64(),
    "url": pa.string(),
    "payload": pa.binary(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.int64(),
}


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def write_record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_response: bool, date: str
) -> bytes:
    """One WARC record. A revisit has the response's HTTP head but no payload."""
    digest = base32_digest(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if is_response else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}")
        lines.append(f"X-Target: {quote(url, safe=':/?#[]@!$&()*+,;=-._~')}")
    if not is_response:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_record_id(refers_to, digest)}")
        lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """Fields of the record that ``raw`` holds; raises if it is cut off or its payload is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if not lines[0].startswith("WARC/") or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_digest(payload) != digest):
        raise ValueError("payload does not match its digest")
    page, target = fields["X-Page-Id"], fields.get("X-Target")
    refers = fields.get("X-Refers-To-Page-Id")
    return {
        "page_id": int(page) if page else None,
        "url": None if target is None else unquote(target),
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers) if refers else None,
    }


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a URI, or of a local path without scheme, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _roles(pages: DataFrame, least_bytes: int, hot_rows: int) -> DataFrame:
    """``pages`` with ``refers_to`` (NULL for responses).

    Only payloads that occur more than once are looked up, and html is not dealt by
    its digest: a payload of ``hot_rows`` rows or more is found in a broadcast table,
    which has at most one row for each ``hot_rows`` pages; the others by digest and
    page, which spreads the copies of a payload.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id",
        "url",
        html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("_sha1"),
        F.xxhash64("page_id", "url").alias("_page"),
    )
    # One row per digest, aggregated before the shuffle.
    long_enough = rows.filter(F.octet_length("html") >= least_bytes)
    found = long_enough.groupBy("_sha1").agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n"))
    repeated = materialize(found.filter((F.col("_n") > 1) & F.col("_largest").isNotNull()), "repeated")
    hot = repeated.filter(F.col("_n") >= hot_rows).select("_sha1", F.col("_largest").alias("_hot"))
    few = repeated.filter(F.col("_n") < hot_rows).drop("_n")
    # Without html, and with fewer than ``hot_rows`` rows of any digest.
    members = long_enough.select("_sha1", "_page").distinct().join(few, "_sha1")
    members = materialize(members, "members")
    joined = rows.join(F.broadcast(hot), "_sha1", "left").join(members, ["_sha1", "_page"], "left")
    refers = F.coalesce("_hot", "_largest")
    revisit = refers.isNotNull() & ~F.col("page_id").eqNullSafe(refers)
    return joined.select("page_id", "url", "html", F.when(revisit, refers).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    archive_bytes: int = 64 << 20,
    date: str = "2000-01-01T00:00:00Z",
    hot_rows: int = 100_000,
) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``); returns the index.

    Other columns of ``pages`` are not read.
    Of records with equal payloads of at least ``least_bytes`` bytes the one with
    the largest page_id is the response. A task writes under a name of its own
    and moves each file to its place when it is whole, so a task that is lost or
    run twice leaves no half files. NULL html counts as empty; a row with NULL
    page_id is a revisit where a numbered row has its payload; rows that repeat
    the largest page_id are all responses. An empty table writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        rows: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = b"".join(held)
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{root}/.{name}", compression=None) as out:
                out.write(data)
            store.move(f"{root}/.{name}", f"{root}/{name}")
            arrays = [pa.array([f"{folder}/{name}"] * len(rows), pa.string())]
            for column, kind in zip(
                zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True
            ):
                arrays.append(pa.array(column, kind))
            held.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["file", "offset", "length", "url", "digest"])

        for batch in batches:
            for page in batch.to_pylist():
                payload = page["html"].encode()
                record = write_record(
                    page["page_id"], page["url"], payload, page["refers_to"], page["refers_to"] is None, date
                )
                raw = gzip.compress(record, 5, mtime=0)
                rows.append((size, len(raw), page["url"], base32_digest(payload)))
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
                    size = 0
        if rows:
            yield close()

    # The written index is what counts: files of a task that ran twice are in no index.
    return materialize(_roles(pages, least_bytes, hot_rows).mapInArrow(write, INDEX), "warc-index")


def _ranges(entries: Iterable[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, list]]:
    """Sorted entries as (file, start, entries) whose bytes are read at once."""
    file, start, end, held = None, 0, 0, []
    for name, offset, length in entries:
        near = name == file and offset - end <= gap and offset + length - start <= most
        if held and not near:
            yield file, start, held
            held = []
        if not held:
            file, start = name, offset
        end = max(end, offset + length) if held else offset + length
        held.append((offset, length))
    if held:
        yield file, start, held


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records of the selected ``index`` entries, read in coalesced ranges.

    Ranges whose distance is at most ``gap`` bytes are read together, up to
    ``most`` bytes. Repeated entries give repeated records. Every response is
    checked against its digest.
    """
    spark = index.sparkSession
    n_bytes = index.agg(F.sum("length")).first()[0] or 0
    n_parts = parts(spark, n_bytes, 32 << 20)
    # A file's stretch of 32 MB goes to one task, so no large file holds up one.
    stretch = F.floor(F.col("offset") / (32 << 20))
    ordered = index.repartition(n_parts, F.col("file"), stretch).sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (
            row
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
        )
        for file, start, held in _ranges(entries, gap, most):
            store, path = _filesystem(file)
            last = max(a + n for a, n in held)
            with store.open_input_file(path) as archive:
                raw = archive.read_at(last - start, start)
            found = [read_record(gzip.decompress(raw[a - start : a - start + n])) for a, n in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], kind) for k, kind in KINDS.items()], names=list(KINDS)
            )

    return ordered.select("file", "offset", "length").mapInArrow(fetch, RECORD)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives below the one that all executors share."""
    return new_folder(pages.sparkSession, "warc")
