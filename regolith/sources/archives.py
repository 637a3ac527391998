"""Delimited files inside ZIP bodies: members are found from the central directory and inflated in parallel.

A body is read once, where it stands; what travels on is a row a member with its compressed bytes, so
members of one archive are spread over tasks, and a member is inflated only as far as its rows are
wanted."""

from __future__ import annotations

import codecs
import csv
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import any_of
from .parsers import as_raw

_LOCAL = struct.Struct("<26xHH")  # lengths of name and extra field in a member's own header
_MEMBERS = "url string, ord int, member string, method int, body binary"
_PIECE = 1 << 16

# Column names of one meaning, in order of preference
ALIASES = {
    "product": ("PRODUCT", "Product", "product_name", "PRODUCT_NAME"),
    "reaction": ("REACTIONS", "Reactions", "event_type", "AE_TYPE"),
    "outcome": ("OUTCOMES", "Outcomes", "outcome", "OUTCOME"),
    "date": ("DATE", "Date", "report_date", "REPORT_DATE"),
}


def _directory(url: str, body: bytes) -> Iterator[tuple[str, int, str, int, bytes]]:
    if body[:2] != b"PK":
        yield url, 0, url, 0, body
        return
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        for i, m in enumerate(z.infolist()):
            if m.is_dir() or m.flag_bits & 1 or m.compress_type not in (0, 8):  # a folder, encrypted, or of another method
                continue
            name, extra = _LOCAL.unpack_from(body, m.header_offset)
            at = m.header_offset + _LOCAL.size + name + extra
            yield url, i, m.filename, m.compress_type, body[at : at + m.compress_size]


def members(bodies: DataFrame) -> DataFrame:
    """(url, ord, member, method, body): the readable members of (url, body), in directory order; a body that
    is no archive is its own member, a broken archive has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, body in zip(b.column("url").to_pylist(), b.column("body"), strict=True):
                try:
                    found = list(_directory(url, body.as_py() or b""))
                except (zipfile.BadZipFile, struct.error, NotImplementedError):
                    found = []
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["url", "ord", "member", "method", "body"])

    return bodies.select("url", "body").mapInArrow(run, _MEMBERS)


def _text(method: int, body: bytes) -> Iterator[str]:
    """A member's text piece by piece; broken data ends it."""
    decode = codecs.getincrementaldecoder("utf-8-sig")("replace").decode
    inflate = zlib.decompressobj(-15) if method == 8 else None
    for a in range(0, len(body), _PIECE):
        piece = body[a : a + _PIECE]
        try:
            while piece:
                out = inflate.decompress(piece, _PIECE) if inflate else piece
                yield decode(out)
                piece = inflate.unconsumed_tail if inflate else b""
        except zlib.error:
            return
    yield decode(b"", True)


def _lines(method: int, body: bytes) -> Iterator[str]:
    held = ""
    for piece in _text(method, body):
        *whole, held = (held + piece).split("\n")
        yield from (x + "\n" for x in whole)
    if held:
        yield held


def csv_rows(found: DataFrame, most: int = 20) -> DataFrame:
    """(url, ord, member, i, cells, fields): the first ``most`` rows of headed members; ``cells`` by column name,
    ``fields`` the first ten as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                rows = []
                try:
                    for i, row in enumerate(csv.DictReader(_lines(m["method"], m["body"]))):
                        if i >= most:
                            break
                        plain = {k: v for k, v in row.items() if k is not None}
                        rows.append({"url": m["url"], "ord": m["ord"], "member": m["member"], "i": i, "cells": [(k, v) for k, v in plain.items()], "fields": str(dict(list(row.items())[:10]))})
                except csv.Error:
                    pass  # what was read before stays
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    spread = found.repartition(F.col("url"), F.col("ord"))
    return spread.mapInArrow(run, "url string, ord int, member string, i int, cells map<string,string>, fields string")


_ROWS = pa.schema([("url", pa.string()), ("ord", pa.int32()), ("member", pa.string()), ("i", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())), ("fields", pa.string())])


def first_csv(found: DataFrame) -> DataFrame:
    """Of each body the first member that is a CSV file; a body that is no archive counts if its address ends so."""
    ok = found.where(F.lower("member").endswith(".csv"))
    first = ok.groupBy("url").agg(F.min("ord").alias("ord"))
    return ok.join(first, ["url", "ord"], "left_semi")


def cell(name: str) -> Column:
    """The first filled cell of a meaning's column names, trimmed."""
    return F.trim(F.coalesce(*[F.nullif(F.col("cells")[x], F.lit("")) for x in ALIASES[name]], F.lit("")))


def adverse_event_files(bodies: DataFrame, source: str, relevant: Sequence[str], now: Column, read: int = 20, keep: int = 10) -> DataFrame:
    """Raw signals of adverse-event files (url, body): of each file's first CSV member the first ``read`` rows, of
    those the first ``keep`` that have a product and a relevant word."""
    rows = csv_rows(first_csv(members(bodies)), read)
    d = rows.select("url", "i", "fields", *[cell(n).alias(n) for n in ALIASES])
    d = d.where(F.col("product") != "").where(any_of(F.lower(F.concat_ws(" ", "product", "reaction")), relevant))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("i"))).where(F.col("k") <= keep)
    body = F.format_string("Source: %s Adverse Event Report\nProduct: %s\nAdverse Event / Reactions: %s\nOutcome: %s\nReport Date: %s\nAll fields: %s", F.lit(source.upper()), "product", "reaction", "outcome", "date", "fields")
    d = d.select("url", F.concat(F.lit("Adverse Event: "), F.substring("product", 1, 100)).alias("title"), body.alias("body_text"), now.alias("scraped_at"), "product", "i")
    return as_raw(d, "adverse_events", F.concat_ws("::", "url", "product", F.col("i").cast("string")))
