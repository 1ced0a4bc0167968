"""WARC archives with a two-level capture index.

Pages become gzipped records in archive files, one record a member, so that each can be read by itself. Captures
are sorted by their reversed-host URL key (example.com/a: `com,example)/a`) and then id, written as blocks of BLOCK
lines, each block compressed by itself, with a sparse directory that has each block's first key. A lookup
searches the shards' first keys, then a shard's directory, both by bisection, and reads just that block and then
just that record.

Everything is dealt out by ranges of (key, id) or (archive, offset), so one host, however large, is spread like
any other keys, and reads go forward through the files. The only thing held by all is the list of shards: one
first key for each index file. Files are written in the shared folder; a task that is repeated writes
new files, and only those of the attempt that Spark commits are referred to.

Defined cases: null html is an empty payload; a null url has the key `)`; a null id is kept and sorts first; of equal
payloads of at least `least_bytes`, the smallest non-null id's rows are responses and the others revisit it; equal
ids with equal payloads are all responses; a lookup returns each of several captures with the same key and id; no
pages make no archives.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import require_small, staged, staging_path

BLOCK = 256
SHARD_ROWS, SHARDS = 1 << 13, 10_000  # captures in an index shard, unless that makes too many shards
ARCHIVE_BYTES = 256 << 20
FETCH_BYTES = 8 << 20  # what a task reads, about
LEVEL = 5
CAPTURE = "key string, page_id long, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def url_key(url: Column) -> Column:
    """The reversed-host key: lower-case host parts from the last to the first, port, `)`, then path and query."""
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts, 1)), r"\.")), ",")
    path = F.regexp_extract(url, parts, 3)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    known = F.concat(host, F.regexp_extract(url, parts, 2), F.lit(")"), path)
    return F.coalesce(F.when(url.rlike(parts), known).otherwise(F.concat(F.lit(")"), url)), F.lit(")"))


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit: the same without its payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A record's RECORD fields; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(":")[1]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if not version.startswith("WARC/") or len(body) != int(fields["Content-Length"]):
        raise ValueError("not a whole WARC record")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(x) if (x := fields.get(name, "")[10:-1]) else None  # noqa: E731  <urn:page:N>
    url = json.loads(f'"{fields["WARC-Target-URI"]}"') if "WARC-Target-URI" in fields else None
    return number("WARC-Record-ID"), url, kind, digest, size, number("WARC-Refers-To"), payload if kind == "response" else None


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under path; returns their captures as a written table."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("key"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("sha1", F.sha1("payload"))
    sized = rows.filter(F.length("payload") >= least_bytes)
    firsts = sized.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = staged(firsts, "first-captures")  # so that the join is of two plain shuffles, whose hot payloads Spark splits
    judged = rows.join(firsts, "sha1", "left").select(
        "page_id", "url", "key", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        store.create_dir(base, recursive=True)
        name, at, out = "", ARCHIVE_BYTES, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                captures = []
                for page_id, url, key, payload, refers_to in zip(*(c.slice(start, 256).to_pylist() for c in batch.columns)):
                    if at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url, payload, base32_sha1(payload), refers_to), LEVEL, mtime=0)
                    out.write(member)
                    captures.append((key, page_id, name, at, len(member)))
                    at += len(member)
                yield _batch(captures, CAPTURE)
        if out:
            out.close()

    return staged(judged.mapInArrow(run, CAPTURE), "captures")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def _order(key: str, page_id: int | None) -> tuple:
    return key, page_id is not None, page_id or 0


def write_index(captures: DataFrame, path: str) -> list[tuple[tuple, str]]:
    """Writes sorted shards under path, each a file of compressed blocks and one of its directory; returns their first keys."""
    n = min(SHARDS, 1 + captures.count() // SHARD_ROWS)
    rows = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        store.create_dir(base, recursive=True)
        name, at, first = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None
        lines, blocks, directory = [], None, None

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            blocks.write(block)
            directory.write((json.dumps([*lines[0][:2], at, len(block)]) + "\n").encode())
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if blocks is None:
                    first = row[:2]
                    blocks, directory = (store.open_output_stream(f"{base}/{name}.{x}", compression=None) for x in ("cdx", "dir"))
                lines.append(row)
                if len(lines) == BLOCK:
                    flush()
        if blocks:
            if lines:
                flush()
            blocks.close()
            directory.close()
            yield _batch([(*first, name)], "key string, page_id long, shard string")

    shards = staged(rows.mapInArrow(run, "key string, page_id long, shard string"), "index-shards")
    found = shards.limit(2 * SHARDS + 1).collect()  # one row for each index file
    require_small(len(found), 2 * SHARDS, "index shards")
    return sorted((_order(r.key, r.page_id), r.shard) for r in found)


class Index:
    """A reader of one task: keeps one directory and one block."""

    def __init__(self, path: str, shards: list[tuple[tuple, str]]):
        self.store, self.base = filesystem(path)
        self.firsts, self.names = [s for s, _ in shards], [n for _, n in shards]
        self.shard, self.block = -1, (-1, -1)
        self.directory: list = []
        self.lines: list = []

    def _open(self, shard: int) -> None:
        if shard != self.shard:
            with self.store.open_input_stream(f"{self.base}/{self.names[shard]}.dir", compression=None) as f:
                self.directory = [(_order(*x[:2]), *x[2:]) for x in map(json.loads, f.read().splitlines())]
            self.shard = shard
            self.blocks = self.store.open_input_file(f"{self.base}/{self.names[shard]}.cdx")

    def _read(self, shard: int, block: int) -> None:
        if (shard, block) != self.block:
            _, at, length = self.directory[block]
            self.blocks.seek(at)
            self.lines = [(_order(*x[:2]), x) for x in map(json.loads, zlib.decompress(self.blocks.read(length)).splitlines())]
            self.block = shard, block

    def find(self, key: str, page_id: int | None) -> Iterator[tuple]:
        """The captures with this key and id."""
        want = _order(key, page_id)
        shard = bisect.bisect_right(self.firsts, want) - 1
        if shard < 0:
            return
        self._open(shard)
        block = max(0, bisect.bisect_left(self.directory, want, key=lambda d: d[0]) - 1)
        while block < len(self.directory) and self.directory[block][0] <= want:
            self._read(shard, block)
            at = bisect.bisect_left(self.lines, want, key=lambda x: x[0])
            while at < len(self.lines) and self.lines[at][0] == want:
                yield tuple(self.lines[at][1])
                at += 1
            block += 1


def lookup(keys: DataFrame, path: str, shards: list[tuple[tuple, str]]) -> DataFrame:
    """CAPTURE rows of the index for each distinct (key, page_id) of keys; those that it lacks give none."""
    rows = keys.select("key", "page_id").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = Index(path, shards), None
        for batch in batches:
            found = []
            for want in zip(*(c.to_pylist() for c in batch.columns)):
                if want != last:
                    found += index.find(*want)
                last = want
            yield _batch(found, CAPTURE)

    return rows.mapInArrow(run, CAPTURE)


def fetch(captures: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of the captures, each read by its range; without payloads if they aren't wanted.

    Tasks are as many as the bytes to read call for: the rows to shuffle are tiny and would all go to one.
    """
    located = staged(captures.select("archive", "offset", "length"), "located")
    size = located.agg(F.sum("length")).first()[0] or 0
    rows = located.repartitionByRange(1 + size // FETCH_BYTES, "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(path)
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                out = []
                for archive, offset, length in zip(*(c.slice(start, 128).to_pylist() for c in batch.columns)):
                    if archive != name:
                        name, source = archive, store.open_input_file(f"{base}/{archive}")
                    source.seek(offset)
                    *fields, payload = parse(gzip.decompress(source.read(length)))
                    out.append((*fields, payload if payloads else None))
                yield _batch(out, RECORD)

    return rows.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), as read back through the index."""
    spark = pages.sparkSession
    archives, index = staging_path(spark, "archives"), staging_path(spark, "index")
    shards = write_index(write_archives(pages, archives, least_bytes), index)
    keys = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    records = fetch(lookup(keys, index, shards), archives, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
