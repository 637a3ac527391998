"""Pages in small pieces, so that a Python worker's memory does not grow with the pages of a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

BATCH_ROWS = 1000
PIECE_BYTES = 256 << 10


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def pieces(batch: pa.RecordBatch, column: str = "html", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in pieces of about ``most`` bytes of a text column, a row at least."""
    sizes = [n or 0 for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def rows_of_pages(found: Callable[[str], list[tuple]], fields: list[tuple[str, pa.DataType]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map of (page_id, html) to rows (page_id, pos, fields) of what is found on each page; ``pos`` counts it."""
    schema = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), *fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                pages = zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True)
                out = [(page, i, *x) for page, html in pages for i, x in enumerate(found(html or ""))]
                columns = list(zip(*out, strict=True)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)

    return walk
