"""Token ids in a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, is shared by all files. A
block holds whole documents in ascending doc_id order and is independent of all
others. Inside a block the ids are dealt round robin to interleaved lanes, each
a 64-bit state that spills 32-bit words, so numpy steps all lanes at once. A
block keeps checkpoints (lane states and word position at fixed steps), from
which its segments decode independently, and checksums of its bytes and ids.

Files are Parquet tables whose ``payload`` column holds blocks; the row beside
it (part, block, n_docs, n_tokens) finds a block without opening it. The shared
frequency table is stored beside them, so any later session can decode them.
Spark commits the files, so a lost executor costs a re-run task, never a torn
file. Decoding takes all whole segments of a block at once from their
checkpoints, in one array.

Scale: documents are tokenized once and staged as 16- or 32-bit ids; counting
and encoding read that. Ordering is a range partition by doc_id over staged
ids. The table broadcast to encoders has one entry per vocabulary id.

Defined results: a null or empty text is its end id alone; a null doc_id sorts
first; rows with equal doc_id keep any order among themselves; an empty table
gives no files' rows and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, staged
from .tokens import ENCODE_BYTES, with_ends, worker_tokenizer
from .words import bytes_of, plain, sliced

MAGIC = b"FRNS"
#: Bits of the frequency scale, and the lower end of a lane's state.
SCALE_BITS, LOW = 20, np.uint64(1 << 31)
#: A block is closed at this many ids; segments between checkpoints have this many steps.
BLOCK_TOKENS, SEGMENT_STEPS, MAX_LANES = 1 << 19, 128, 1024
_HEAD = struct.Struct("<4sIIIQII")


def frequency_table(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of all ids, one at least for each that occurs, with sum 2**bits."""
    total = int(counts.sum())
    freq = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if len(seen):
        freq[seen] = np.maximum(1, counts[seen].astype(np.float64) * (1 << bits) // total)
        surplus = int(freq.sum()) - (1 << bits)
        for i in seen[np.argsort(-freq[seen], kind="stable")] if surplus > 0 else []:
            take = min(surplus, int(freq[i]) - 1)
            freq[i] -= take
            surplus -= take
            if not surplus:
                break
        if surplus < 0:
            freq[seen[freq[seen].argmax()]] -= surplus
    return freq.astype(np.uint32)


class Codec:
    """Encoder and decoder of blocks under one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.limit = self.freq << np.uint64(63 - bits)

    def encode(self, ids: np.ndarray) -> bytes:
        """One block. Every id must have a frequency."""
        n = len(ids)
        lanes = 1
        while lanes < MAX_LANES and lanes * 256 < n:
            lanes *= 2
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, bytes]] = []
        emitted, low, high, bits = 0, np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(self.bits)
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            k = len(s)  # only the last step may be short
            x, f = state[:k], self.freq[s]
            full = x >= self.limit[s]
            if full.any():
                words.append((x[full] & low).astype("<u4"))
                emitted += len(words[-1])
                x[full] >>= high
            q = x // f
            state[:k] = (q << bits) + (x - q * f) + self.start[s]
            if t % SEGMENT_STEPS == 0:
                marks.append((emitted, state.astype("<u8").tobytes()))
        marks.reverse()
        body = b"".join([struct.pack("<Q", emitted - at) + held for at, held in marks] + [w.tobytes() for w in reversed(words)])
        head = _HEAD.pack(MAGIC, self.bits, lanes, len(marks), n, emitted, zlib.crc32(ids.astype("<u4")))
        return head + struct.pack("<I", zlib.crc32(body)) + body

    def segments(self, block: bytes) -> int:
        return _HEAD.unpack_from(block)[3]

    def decode(self, block: bytes, segment: int | None = None) -> np.ndarray:
        """Ids of a block, its segments side by side; or of one segment, which starts at its own checkpoint."""
        magic, bits, lanes, marks, n, emitted, ids_crc = _HEAD.unpack_from(block)
        (body_crc,) = struct.unpack_from("<I", block, _HEAD.size)
        at = _HEAD.size + 4
        if magic != MAGIC or bits != self.bits or zlib.crc32(memoryview(block)[at:]) != body_crc:
            raise ValueError("a token block is damaged")
        mark_size = 8 + 8 * lanes
        words = np.frombuffer(block, "<u4", emitted, at + marks * mark_size).astype(np.uint64)
        steps = -(-n // lanes)
        if n == 0:
            return np.empty(0, np.uint32)
        if segment is None:
            held = np.frombuffer(block, np.uint8, marks * mark_size, at).reshape(marks, mark_size)
            whole = n // (lanes * SEGMENT_STEPS)
            out = [self._side_by_side(np.ascontiguousarray(held[:whole]), words, lanes)] + [self._segment(block, k, at, mark_size, words, n, lanes, steps) for k in range(whole, marks)]
            out = np.concatenate(out)
            if zlib.crc32(out.astype("<u4")) != ids_crc:
                raise ValueError("a token block's ids don't match their checksum")
            return out
        return self._segment(block, segment, at, mark_size, words, n, lanes, steps)

    def _side_by_side(self, marks: np.ndarray, words: np.ndarray, lanes: int) -> np.ndarray:
        """Ids of whole segments, all decoded at once from their checkpoints (bytes, a row each)."""
        n = len(marks)
        pos = marks[:, :8].copy().view("<u8").ravel().astype(np.int64)
        x = marks[:, 8:].copy().view("<u8").astype(np.uint64)
        out = np.empty((n, SEGMENT_STEPS, lanes), np.uint32)
        mask, high, bits = np.uint64((1 << self.bits) - 1), np.uint64(32), np.uint64(self.bits)
        for t in range(SEGMENT_STEPS if n else 0):
            slot = x & mask
            s = self.symbol[slot]
            out[:, t] = s
            x = self.freq[s] * (x >> bits) + slot - self.start[s]
            row, lane = np.nonzero(x < LOW)
            if len(row):
                count = np.bincount(row, minlength=n)
                take = np.arange(len(row)) + np.repeat(pos - (np.cumsum(count) - count), count)
                x[row, lane] = x[row, lane] << high | words[take]
                pos += count
        return out.ravel()

    def _segment(self, block: bytes, segment: int, at: int, mark_size: int, words: np.ndarray, n: int, lanes: int, steps: int) -> np.ndarray:
        """Ids of one segment from its checkpoint on."""
        first, last = segment * SEGMENT_STEPS, min(steps, (segment + 1) * SEGMENT_STEPS)
        mark = at + first // SEGMENT_STEPS * mark_size
        pos = struct.unpack_from("<Q", block, mark)[0]
        state = np.frombuffer(block, "<u8", lanes, mark + 8).astype(np.uint64)
        out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
        mask, high, bits64 = np.uint64((1 << self.bits) - 1), np.uint64(32), np.uint64(self.bits)
        for t in range(first, last):
            k = min(lanes, n - t * lanes)
            x = state[:k]
            slot = x & mask
            s = self.symbol[slot]
            out[(t - first) * lanes : (t - first) * lanes + k] = s
            x = self.freq[s] * (x >> bits64) + slot - self.start[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << high) | words[pos : pos + len(low)]
                pos += len(low)
            state[:k] = x
        return out


def token_table(docs: DataFrame, vocabulary: str, end_id: int, dtype: str, special_as_text: bool = True) -> DataFrame:
    """Staged doc_id and ids (packed little-endian) with the end id."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(vocabulary, False, dtype, special_as_text=special_as_text)
        size = np.dtype(dtype).itemsize
        for batch in batches:
            texts = plain(batch.column(1))
            for a, b in sliced(texts, ENCODE_BYTES):
                ids, at = with_ends(*tok.encode(texts.slice(a, b - a)), end_id)
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), packed], ["doc_id", "ids"])

    return staged(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, ids binary"))


def id_counts(table: DataFrame, dtype: str, vocabulary_size: int) -> np.ndarray:
    """How often each id occurs in the whole table; the result is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            raw, _ = bytes_of(batch.column(0))
            ids = raw.view(dtype) if len(raw) else np.empty(0, dtype)
            for a in range(0, len(ids), 1 << 22):
                total += np.bincount(ids[a : a + (1 << 22)], minlength=vocabulary_size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    found = table.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary_size, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, vocabulary_size: int = 49408, docs_per_part: int = 8192, block_tokens: int = BLOCK_TOKENS, special_as_text: bool = True) -> None:
    """Encode all documents into files at ``path``: blocks, and the shared frequency table."""
    dtype = "<u2" if vocabulary_size <= 1 << 16 else "<u4"
    table = token_table(docs, vocabulary, end_id, dtype, special_as_text)
    freq = frequency_table(id_counts(table, dtype, vocabulary_size))
    spark = table.sparkSession
    stored = spark.createDataFrame([(SCALE_BITS, bytearray(freq.astype("<u4").tobytes()))], "bits int, frequencies binary")
    stored.coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    parts = cut(table.count(), docs_per_part)
    # Rows of one id (or of none) are told apart by their ids, so that they can be dealt out too.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc()]
    ordered = table.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        part, block, held, keys, size = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(x, dtype) for x in held])
            cols = [[part], [block], [len(held)], [len(ids)], [keys], [[len(x) // ids.itemsize for x in held]], [codec.encode(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, shape, strict=True)], schema=shape)

        shape = None
        for batch in batches:
            shape = shape or pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(ids.as_py())
                keys.append(k)
                size += len(held[-1]) // np.dtype(dtype).itemsize
                if size >= block_tokens:
                    yield flush()
                    block, held, keys, size = block + 1, [], [], 0
        if held:
            yield flush()

    kinds = f"part int, block int, n_docs long, n_tokens long, doc_ids array<{key}>, lengths array<long>, payload binary"
    blocks = ordered.select("doc_id", "ids", F.spark_partition_id().alias("part")).mapInArrow(run, kinds)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids, decoded from the files at ``path``.

    ``start`` counts the ids of all documents before, over all files. Nothing
    but the files is needed.
    """
    files, held = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/table").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(held["frequencies"], "<u4"), held["bits"]))
    key = files.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "part", "block", "at", "n_tokens", "ids_crc32", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, keys, lengths, payload = (batch.column(c)[i] for c in range(5))
                got = codec.decode(payload.as_py()).astype("<u4")
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                each = [got[e - k : e] for e, k in zip(ends, n, strict=True)]
                cols = [
                    keys.values, pa.array([part.as_py()] * len(n), pa.int32()), pa.array([block.as_py()] * len(n), pa.int32()),
                    pa.array(ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ]
                if ids:
                    cols.append(pa.array([x.astype("<i4") for x in each], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = f"doc_id {key}, part int, block int, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    rows = files.select("part", "block", "doc_ids", "lengths", "payload").mapInArrow(run, kinds)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    heads = files.select("part", "block", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("inside"))
    offsets = heads.join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("offset"))
    rows = rows.join(offsets, ["part", "block"])
    return rows.select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, vocabulary_size: int = 49408, ids: bool = False) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    path = shared_dir(docs.sparkSession)
    write_token_files(docs, vocabulary, path, end_id, vocabulary_size)
    return read_token_files(docs.sparkSession, path, ids)
