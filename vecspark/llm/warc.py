"""WARC records in seekable Zstandard bundles (operator 2).

A bundle is a file of independent Zstandard frames, each with several whole records, and a last skippable
frame with the seek table (the public seekable format). The index maps each record's id to its bundle, frame
and offset within the frame's content, so one record is read by decompressing one frame.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the largest page id is stored as
``response``; the others are ``revisit`` records, whose block holds the HTTP head only. Executors write
bundles under unique names in the shared folder, and the index, itself a table there, lists the bundles of
finished tasks only: a repeated task leaves an unlisted file, never a second record.

Defined cases: null html is an empty payload, null url an empty target; rows that repeat a page id each get a
record, a repeat with the largest id stays a response; a null page id gives a record whose id reads back as
null; a payload larger than a frame has its own frame; an empty table gives an empty index; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch, table, written

MIN_REVISIT, FRAME_BYTES, BUNDLE_BYTES, TASK_BYTES = 1000, 256 << 10, 64 << 20, 32 << 20
#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, frame_start long, offset long, length long"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One WARC/1.1 record with an HTTP response; a revisit if ``refers_to`` is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", "WARC-Target-URI: " + (url or "").replace("\r", "").replace("\n", ""), f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), head, payload, b"\r\n\r\n"))


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at ``at``."""
    top = data.index(b"\r\n\r\n", at)
    lines = data[at:top].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    start, end = top + 4, top + 4 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut short")
    return fields, data[start:end], end + 4


class Bundle:
    """Frames of records, and the seek table at the end."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.done, self.table, self.open, self.filled, self.size = [], [], [], 0, 0
        self.places: list[tuple[int, int, int, int]] = []

    def add(self, rec: bytes) -> None:
        if self.filled and self.filled + len(rec) > self.frame_bytes:
            self.flush()
        self.places.append((len(self.table), self.size, self.filled, len(rec)))
        self.open.append(rec)
        self.filled += len(rec)

    def flush(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.table.append((len(frame), self.filled))
            self.done.append(frame)
            self.size += len(frame)
            self.open, self.filled = [], 0

    def close(self) -> bytes:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join([*self.done, struct.pack("<II", SKIPPABLE, len(body)), body])


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Of each frame: start, compressed and plain size, as the footer says."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, c, d))
        at += c
    return out


def footer(file) -> list[tuple[int, int, int]]:
    """The seek table of an open bundle; reads nothing else of it."""
    size = file.size()
    file.seek(size - 9)
    last = file.read(9)
    file.seek(max(size - 9 - 8 * struct.unpack("<IBI", last)[0], 0))
    return seek_table(file.read())


def read_frame(data: bytes, frame: int) -> bytes:
    start, c, d = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[start : start + c], max_output_size=d) if d else b""


def write_bundles(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, broadcast_rows: int = 100_000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as bundles in ``folder``; the index of their records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep")
    large = written(large, "repeats")
    if large.count() <= broadcast_rows:
        large = F.broadcast(large)
    rows = rows.join(large, "digest", "left").select("page_id", "url", "payload", "digest", F.expr("case when keep is not null and not (page_id <=> keep) then keep end").alias("refers_to"))

    def write(batches):
        from pyarrow import fs

        disk, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        disk.create_dir(root, recursive=True)
        bundle, ids = Bundle(frame_bytes), []

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with disk.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(bundle.close())
            p = list(zip(*bundle.places))
            cols = [pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.string()), pa.array(p[0], pa.int32()), *(pa.array(x, pa.int64()) for x in p[1:])]
            return pa.RecordBatch.from_arrays(cols, ["page_id", "bundle", "frame", "frame_start", "offset", "length"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*cols):
                bundle.add(record(*row))
                ids.append(row[0])
                if bundle.size >= bundle_bytes:
                    yield close()
                    bundle, ids = Bundle(frame_bytes), []
        if ids:
            yield close()

    return written(rows.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Read the index's records back by their places; a stored payload is checked against its digest.

    Frames next to each other go to one task, some ``task_bytes`` of records to each; a task seeks to its frames.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    places = index.select("page_id", "bundle", "frame", "frame_start", "offset")
    places = places.repartitionByRange(parts, "bundle", "frame_start").sortWithinPartitions("bundle", "frame_start", "offset")

    def page(urn: str | None):
        body = urn[len("<urn:page:") : -1] if urn else "None"
        return None if body == "None" else int(body)

    def read(batches):
        from pyarrow import fs

        disk, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        zstd, name, file, frames, now, plain = zstandard.ZstdDecompressor(), None, None, [], None, b""
        try:
            for b in batches:
                rows = []
                for want, bundle, frame, start, at in zip(*(c.to_pylist() for c in b.columns)):
                    if bundle != name:
                        if file is not None:
                            file.close()
                        file, name, now = disk.open_input_file(f"{root}/{bundle}"), bundle, None
                        frames = footer(file)
                    if frame != now:
                        place, c, d = frames[frame]
                        if place != start:
                            raise ValueError(f"frame {frame} of {bundle} isn't where the index says")
                        file.seek(place)
                        plain, now = zstd.decompress(file.read(c), max_output_size=d), frame
                    fields, block, _ = parse(plain, at)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    digest, found = fields["warc-payload-digest"].removeprefix("sha1:"), page(fields["warc-record-id"])
                    if found != want:
                        raise ValueError(f"the record of page {found} stands in the place of page {want}")
                    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                    rows.append((found, size, digest, fields["warc-type"], page(fields.get("warc-refers-to"))))
                cols = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        finally:
            if file is not None:
                file.close()

    return places.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_record(index: DataFrame, folder: str, page_id: int) -> list[tuple[dict[str, str], bytes]]:
    """The records of one page, by its place in the index: one frame is read of a bundle."""
    from pyarrow import fs

    disk, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    out = []
    for r in index.where(F.col("page_id") == page_id).collect():
        with disk.open_input_file(f"{root}/{r.bundle}") as f:
            f.seek(r.frame_start)
            plain = zstandard.ZstdDecompressor().stream_reader(f, closefd=False).read(r.offset + r.length)
        out.append(parse(plain, r.offset)[:2])
    return out


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), folder), folder)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
     k AS (SELECT digest, max(page_id) AS keep FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.keep <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keep <> d.page_id THEN k.keep END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest AND d.n >= 1000
"""
