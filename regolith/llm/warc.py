"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames of about ``frame_bytes`` of records each,
then a skippable frame with the seek table (compressed and raw size of every frame) and its
footer.  A record is found by ``(frame, offset in the frame, length)``, which the index
columns beside each bundle map from its identifier; one frame is all that is decompressed.

Bundles are rows of a table ``(bundle, content, ids, frames, offsets, lengths)`` in the shared
folder, so that any store that Spark can write takes them and a lost task leaves nothing
behind; :func:`export_files` writes ``content`` as plain ``.warc.zst`` files.

Of records with equal payloads of at least ``least_bytes`` the one with the smallest id is
a response and the others are revisits that refer to it; shorter payloads are all responses.

Defined results: null payloads are empty; a null url becomes ``urn:unknown``; a null id
counts as larger than all others and stays null; rows that repeat both the id and the payload
of a response are responses too; other columns are ignored; an empty table gives no bundles.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .textkit import bound_batches, materialize, required

_LAST = (1 << 63) - 1
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BUNDLE_SQL = "bundle string, content binary, ids array<long>, frames array<int>, offsets array<long>, lengths array<long>"


def _name(page: int) -> str:
    return "<urn:page:none>" if page == _LAST else f"<urn:page:{page}>"


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to``) has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "urn:unknown")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not match its content")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, read from the footer."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        packed, raw = struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - i))
        out.append((at, packed, raw))
        at += packed
    return out


def fetch(content: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, decompressing its frame alone."""
    import zstandard

    start, packed, raw = frames(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=raw)[offset : offset + length]


class Bundle:
    """Collects records into frames and frames into bundle rows."""

    def __init__(self, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.made = 0
        self._reset()

    def _reset(self) -> None:
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.packed = 0

    def close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            if len(raw) >= 1 << 32:
                raise ValueError("a frame of 4 GiB cannot be addressed by the seek table")
            done = self.packer.compress(raw)
            self.parts.append(done)
            self.sizes.append((len(done), len(raw)))
            self.packed += len(done)
            self.open, self.filled = [], 0

    def add(self, page: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        if self.open and self.filled + len(raw) > self.frame_bytes:
            self.close_frame()
            if self.packed >= self.bundle_bytes:
                yield self.close()
        self.index.append((page, len(self.sizes), self.filled, len(raw)))
        self.open.append(raw)
        self.filled += len(raw)

    def close(self) -> pa.RecordBatch:
        self.close_frame()
        ids, frame, offset, length = zip(*self.index, strict=True)
        content = b"".join(self.parts) + seek_table(self.sizes)
        name = f"part-{TaskContext.get().partitionId():06d}-{self.made:04d}.warc.zst"
        self.made += 1
        self._reset()
        return pa.record_batch(
            [pa.array([name]), pa.array([content], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([frame], pa.list_(pa.int32())), pa.array([offset], pa.list_(pa.int64())), pa.array([length], pa.list_(pa.int64()))],
            names=["bundle", "content", "ids", "frames", "offsets", "lengths"],
        )


def _write(frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches):
        bundle = Bundle(frame_bytes, bundle_bytes, level)
        for batch in batches:
            page, url, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i, p in enumerate(page):
                payload = batch.column(2)[i].as_py().encode()
                yield from bundle.add(p, record(p, url[i], payload, hashlib.sha256(payload).hexdigest(), refers[i]))
        if bundle.index:
            yield bundle.close()

    return run


def write_warc(pages: DataFrame, least_bytes: int = 100, frame_bytes: int = 1 << 20, bundle_bytes: int = 16 << 20, level: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages' bundles to the shared folder and return them as a table."""
    bound_batches(pages.sparkSession)
    pages = required(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    pages = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_LAST)).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    marks = pages.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    first = marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to <> last").drop("last")
    again = marks.join(first, "digest").where("page_id <> refers_to").distinct()
    rows = pages.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return materialize(rows.mapInArrow(_write(frame_bytes, bundle_bytes, level), _BUNDLE_SQL), "warc")


def _read(batches):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    number = lambda x: int(x[10:-1]) if x[10:-1] != "none" else _LAST  # noqa: E731  <urn:page:N>
    for batch in batches:
        for i in range(batch.num_rows):
            content = batch.column(1)[i].as_buffer()
            view = memoryview(content)
            table = frames(bytes(view[-(9 + 8 * struct.unpack("<IBI", view[-9:])[0]) :]))
            frame, offset, length = (batch.column(c)[i].values.to_pylist() for c in (3, 4, 5))
            out, now, raw = [], -1, b""
            for f, o, n in zip(frame, offset, length, strict=True):
                if f != now:
                    start, packed, size = table[f]
                    raw, now = unpack.decompress(view[start : start + packed], max_output_size=size), f
                fields, payload = parse(raw[o : o + n])
                kind = fields["warc-type"]
                stated = fields["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != stated:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                refers = number(fields["warc-refers-to"]) if kind == "revisit" else None
                out.append((number(fields["warc-record-id"]), len(payload) if kind == "response" else None, stated, kind, refers))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_warc(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Responses are checked against their digest; a revisit takes its size from the response
    that it refers to and whose digest it states."""
    bound_batches(bundles.sparkSession)
    rows = materialize(bundles.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    whole = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("n")).distinct()
    out = rows.join(whole, ["refers_to", "payload_digest"], "left")
    null_last = lambda c: F.nullif(c, F.lit(_LAST)).alias(c)
    return out.select(null_last("page_id"), F.coalesce("payload_bytes", "n").alias("payload_bytes"), "payload_digest", "record_type", null_last("refers_to"))


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file below ``folder``, which all executors must share.

    Returns (path, bytes); a file appears under its name only when complete."""

    def run(batches):
        for batch in batches:
            paths, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = os.path.join(folder, name)
                partial = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
                with open(partial, "wb") as f:
                    f.write(content.as_buffer())
                os.replace(partial, path)
                paths.append(path)
                sizes.append(len(content.as_buffer()))
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return bundles.mapInArrow(run, "path string, bytes long")
