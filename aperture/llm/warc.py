"""WARC archives in seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.llm import common as C

#: Fixed values of the seekable format: magic of the skippable frame, its footer's magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME, BUNDLE = 1 << 20, 256 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    url = "".join((url or "about:blank").split()) or "about:blank"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + n], end + 8 + n


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """A skippable frame: (compressed, whole) size of each frame, then their number, no checksums, and the magic."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed, whole) of each frame, from the end of an open file."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    sizes, at, out = struct.unpack(f"<{2 * n}I", f.read(8 * n)), 0, []
    for c, d in zip(sizes[::2], sizes[1::2]):
        out.append((at, c, d))
        at += c
    return out


def _id(text: str):
    part = text[len("<urn:page:") : -1]
    return int(part) if part else None


_INDEX = "page_id long, file string, frame long, place long, length long"


def _write(folder: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        parts, sizes, frame, index, held = [], [], bytearray(), [], 0

        def close_frame() -> None:
            nonlocal held
            parts.append(packer.compress(bytes(frame)))
            sizes.append((len(parts[-1]), len(frame)))
            held += len(parts[-1])
            frame.clear()

        def close_file() -> Iterator[pa.RecordBatch]:
            nonlocal held
            name = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
            C.write_shared(name, [*parts, seek_table(sizes)])
            ids, frames, places, lengths = zip(*index)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array(frames), pa.array(places), pa.array(lengths)], ["page_id", "file", "frame", "place", "length"])
            parts.clear()
            sizes.clear()
            index.clear()
            held = 0

        for batch in C.batches(rows, "html"):
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode()
                kind = "revisit" if r["refers_to"] is not None else "response"
                x = record(r["page_id"], r["url"], payload, r["digest"], len(payload), kind, r["refers_to"])
                index.append((r["page_id"], len(sizes), len(frame), len(x)))
                frame += x
                if len(frame) >= FRAME:
                    close_frame()
                    if held >= BUNDLE:
                        yield from close_file()
        if frame:
            close_frame()
        if index:
            yield from close_file()

    return run


def _frames(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for name in batch.column(0).to_pylist():
            with C.open_shared(name) as f:
                table = read_seek_table(f)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(table)), *(pa.array(x, pa.int64()) for x in zip(*table))], ["file", "at", "size", "whole"])


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for name, at, size, whole in zip(*(c.to_pylist() for c in batch.columns)):
            with C.open_shared(name) as f:
                f.seek(at)
                data = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=whole)
            p, out = 0, []
            while p < len(data):
                head, block, p = parse(data, p)
                http = block.index(b"\r\n\r\n")
                payload, kind = block[http + 4 :], head["WARC-Type"]
                if kind == "response":
                    n, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
                    if f"sha1:{digest}" != head["WARC-Payload-Digest"]:
                        raise ValueError(f"{name}: a payload does not have its digest")
                else:
                    n = next(int(x[16:]) for x in block[:http].decode().split("\r\n") if x.startswith("Content-Length: "))
                    digest, refers = head["WARC-Payload-Digest"].removeprefix("sha1:"), _id(head["WARC-Refers-To"])
                out.append((_id(head["WARC-Record-ID"]), n, digest, kind, refers))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def lookup(index: DataFrame, page_id: int) -> list[tuple[dict[str, str], bytes]]:
    """The records of a page: one frame of its bundle is read and unpacked, not the bundle."""
    out = []
    for r in index.where(F.col("page_id") == page_id).collect():
        with C.open_shared(r.file) as f:
            at, size, whole = read_seek_table(f)[r.frame]
            f.seek(at)
            data = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=whole)
        head, block, _ = parse(data, r.place)
        out.append((head, block))
    return out


def write_archives(pages: DataFrame, scratch: C.Scratch, least: int = 1000) -> DataFrame:
    """Write `pages` (page_id, url, html) as bundles; returns the index (page_id, file, frame, place, length).

    Payloads are the html in UTF-8, null being empty. Of equal payloads of `least` bytes or more, the
    one with the largest page_id is written whole, the others as revisits of it; if rows repeat that
    page_id, each of them is whole. A row without page_id is never referred to; it revisits a row that
    has one. Extra columns are ignored; an empty table writes nothing.

    Equal payloads are found by digest and length alone, counted in map tasks first. Only (page_id, digest,
    size) is joined with what occurs twice; whom a page refers to then goes back to the pages by page_id and
    digest, of which no two different pages share both, so a payload that a third of all pages have is spread
    over its pages. A revisit is written without its html.
    A task's records go to bundles of its own in the shared folder, under a name that no other attempt
    has; the index names the bundles of the attempts that counted.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    narrow = base.where(F.col("size") >= least).select("page_id", "digest", "size")
    equal = narrow.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "size", "last")
    refers = narrow.join(equal, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("last"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "last").distinct()
    refers = scratch.table(refers, "refers")
    both = base.join(refers, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return scratch.table(both.select("page_id", "url", "html", "digest", F.col("last").alias("refers_to")).mapInArrow(_write(scratch.folder("bundles")), _INDEX), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles of an index, by their seek tables: one row a frame, dealt out evenly."""
    files = index.select("file").distinct()
    frames = files.mapInArrow(_frames, "file string, at long, size long, whole long")
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return frames.repartition(parts).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "warc")
    return read_archives(write_archives(C.read(spark, sf_dir, "pages"), scratch))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
e AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT p.page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN e.last IS NULL OR e.last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN e.last <> p.page_id THEN e.last END AS refers_to
FROM p LEFT JOIN e ON p.h = e.h
"""
