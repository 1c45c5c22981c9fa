"""WARC records in seekable Zstandard bundles, op4.

A bundle is a file of independent Zstandard frames, each holding some whole records; then an index
in a skippable frame, which maps record identifiers to (frame, offset in the frame, length); then the
footer of the seekable format: a seek table with both sizes of every frame. So a record is read with
three small reads, and frames can be read side by side.

Equal payloads: of the records whose payload digests and lengths agree, and that have
``least_bytes`` or more, the one with the largest page_id is the response and the others revisit it.
Smaller payloads are all responses. Rows that share the largest page_id (repeated rows) are all
responses. A null html is an empty payload; a null url leaves out the target; a null page_id gets the
identifier ``none`` and reads back as null: it is smaller than any other, so such a page revisits an equal one
that has a page_id, and without one it is a response. A very long html is one record, in a frame of its own
size. Records of repeated page_ids share their identifier; ``BundleReader.record`` takes which of them is
wanted. Other columns are ignored. An empty table writes nothing.

Equal payloads meet as digests and page_ids only. Of the rest of a row, html included, nothing is shuffled but by
page_id, to meet what it refers to; hubs (rows of one page_id and payload) meet it by broadcast.

Bundles are written by the tasks under names of their own; the manifest that Spark commits names
only those of finished tasks, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hub_join, least_of_hub, look_up_all, parts, read

_SKIP, _SEEK, _FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "path string, records bigint, frames bigint, bytes bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


# ---------------------------------------------------------------- records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = "none" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; a response's digest is computed from its payload and must be the one stated."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind = fields["WARC-Type"]
    if kind == "response" and (digest(payload) != stated or len(payload) != size):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one that was written")
    number = lambda x: None if x is None or x == "none" else int(x)
    page = lambda key: fields[key][len("<urn:page:") : -1] if key in fields else None
    return {"page_id": number(page("WARC-Record-ID")), "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": number(page("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"), "payload": payload}


# ---------------------------------------------------------------- bundles


class BundleWriter:
    def __init__(self, stream, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self.stream, self.frame_bytes, self.compress = stream, frame_bytes, zstandard.ZstdCompressor(level=level).compress
        self.frame, self.size, self.table, self.index, self.bytes = [], 0, [], [], 0

    def add(self, name: str, raw: bytes) -> None:
        self.index.append((name, len(self.table), self.size, len(raw)))
        self.frame.append(raw)
        self.size += len(raw)
        if self.size >= self.frame_bytes:
            self._flush()

    def _write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.bytes += len(raw)

    def _flush(self) -> None:
        if self.frame:
            packed = self.compress(b"".join(self.frame))
            self.table.append((len(packed), self.size))
            self._write(packed)
            self.frame, self.size = [], 0

    def close(self) -> int:
        self._flush()
        frames, body = len(self.table), self.compress(json.dumps(self.index).encode())
        self._write(struct.pack("<II", _SKIP, len(body)) + body)
        self.table.append((8 + len(body), 0))
        rows = b"".join(struct.pack("<II", *x) for x in self.table)
        self._write(struct.pack("<II", _SEEK, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), 0, _FOOT))
        self.stream.close()
        return frames


class BundleReader:
    """Random access: the footer first, then the index, then one frame for a record."""

    def __init__(self, file):
        import zstandard

        self.file, self.expand = file, zstandard.ZstdDecompressor().decompress
        end = file.size()
        count, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
        if magic != _FOOT:
            raise ValueError("no seek table at the end of the bundle")
        rows = file.read_at(8 * count, end - 9 - 8 * count)
        self.table = [struct.unpack_from("<II", rows, 8 * i) for i in range(count)]
        self.at = [0]
        for packed, _ in self.table:
            self.at.append(self.at[-1] + packed)
        self.index = json.loads(self.expand(file.read_at(self.table[-1][0] - 8, self.at[-2] + 8)))

    def frame(self, i: int) -> bytes:
        return self.expand(self.file.read_at(self.table[i][0], self.at[i]), max_output_size=self.table[i][1])

    def record(self, name: str, which: int = 0) -> bytes:
        _, frame, offset, length = [x for x in self.index if x[0] == name][which]
        return self.frame(frame)[offset : offset + length]

    def records(self) -> Iterator[bytes]:
        """All of them, frame by frame."""
        held, body = -1, b""
        for _, frame, offset, length in self.index:
            if frame != held:
                held, body = frame, self.frame(frame)
            yield body[offset : offset + length]


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, bundle_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        writer, name, done = None, "", 0

        def manifest() -> pa.RecordBatch:
            frames = writer.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(writer.index), "frames": frames, "bytes": writer.bytes}])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                if writer is None:
                    name, done = f"{uuid.uuid4().hex}.warc.zst", 0
                    writer = BundleWriter(system.open_output_stream(f"{base}/{name}", compression=None))
                payload = (html.as_py() or "").encode()
                key = page_id.as_py()
                raw = record(key, url.as_py(), payload, refers_to.as_py(), date)
                writer.add("none" if key is None else str(key), raw)
                done += len(raw)
                if done >= bundle_bytes:
                    yield manifest()
                    writer = None
        if writer is not None:
            yield manifest()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            system, path = _open(uri)
            with system.open_input_file(path) as file:
                rows = []
                for raw in BundleReader(file).records():
                    row = parse(raw)
                    del row["payload"]
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


# ---------------------------------------------------------------- the operator


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, *, least_bytes: int = 0, bundle_bytes: int = 1 << 26, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages(page_id, url, html)`` to bundles in ``folder``; returns their manifest."""
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    # a page_id as a key of joins, null and all
    keyed = keyed.withColumns({"key": F.struct(F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("id"), F.col("sha").alias("sha")), "twin": F.struct("sha", "size")})
    ids = scratch.save(keyed.where(F.col("size") >= least_bytes).select("page_id", "key", "twin"), "digests")
    equal = ids.groupBy("twin").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and first is not null")
    equal = scratch.save(equal.select("twin", "first"), "equal")
    refers = hub_join(ids, "twin", equal).where(~F.col("page_id").eqNullSafe(F.col("first")))
    refers = scratch.save(refers.groupBy("key").agg(F.max("first").alias("refers_to"), F.count(F.lit(1)).alias("rows")), "refers")
    marked = look_up_all(keyed.select("page_id", "url", "html", "key"), "key", refers.drop("rows"), refers.where(F.col("rows") > least_of_hub(ids.count())).drop("rows"))
    return scratch.save(marked.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder, bundle_bytes, date), MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    spark = manifest.sparkSession
    return manifest.select("path").repartition(parts(spark), "path").mapInArrow(_read, RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    manifest = write_archives(read(spark, sf_dir, "pages"), f"{scratch.path}/bundles", scratch)
    return read_archives(manifest).drop("url")


ORACLE_SQL = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first, list_transform(range(0, 4), lambda k: ('0x' || substr(h, k * 10 + 1, 10))::BIGINT) AS five FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1, 1)), '') AS payload_digest,
CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d"""
