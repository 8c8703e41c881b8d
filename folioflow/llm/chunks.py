"""Rows dealt to chunks once, in a table bucketed by chunk.

Operators that meet a chunk's texts again with what other chunks had to say of
them (counts, shared passages) store the rows once, as compressed Arrow streams
in a table bucketed by chunk. Joining by chunk then moves only the small side;
texts are not shuffled at all.

A chunk is a run of rows as they are scanned, so no key, copy or null can make
one large, and its number is stored, so a later scan with other splits or a
lost executor can't change it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import importable

from .common import cut, shared_dir
from .tokens import release
from .words import SLICE_BYTES, bytes_of, plain, sliced

#: Bytes of text in a chunk; most buckets of a table.
CHUNK_BYTES, MOST_BUCKETS = 8_000_000, 100_000


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3), use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(rows: pa.ChunkedArray | pa.Array) -> Iterator[pa.RecordBatch]:
    """The slices of a chunk, in order."""
    for blob in rows:
        yield pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


def stored_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, int, int]:
    """chunk, seq and packed rows, about ``slice_bytes`` of ``text`` each; the buckets, and the bytes of all texts."""
    spark = importable(docs.sparkSession)
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        chunk, seq, held = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            texts = plain(batch.column(at))
            place = bytes_of(texts)[1]
            for a, b in sliced(texts, min(slice_bytes, chunk_bytes)):
                blob = packed(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([seq], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "seq", "rows"])
                seq += 1
                held += int(place[b] - place[a])
                if held >= chunk_bytes:
                    chunk, held = chunk + 1, 0

    buckets = min(MOST_BUCKETS, cut(size, chunk_bytes))
    name = f"folio_chunks_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(run, "chunk long, seq int, rows binary")
    rows.write.format("parquet").option("path", shared_dir(spark)).option("compression", "none").bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name), buckets, size


def in_order(table: pa.Table) -> pa.ChunkedArray:
    """A chunk's packed slices by their number."""
    return table.sort_by("seq").column("rows")
