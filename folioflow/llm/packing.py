"""Best-fit packing by sums of squares.

Every document becomes token ids plus an end id. Pieces go into sequences of a
fixed capacity; each piece is placed where the sum, over residual gaps, of the
squared number of open sequences with that gap becomes smallest (a new sequence
is one of the choices). Pieces are offered from the longest to the shortest,
and of equal choices the tightest one wins. What then stands in sequences that
are not full is packed again, and at the end by tightest fit, so that few gaps
stay.

Scale: tokenizing is one map over the documents and its result (lengths and
digests, or ids if wanted) is staged once. Packing needs only lengths, so it
runs on narrow rows in independent blocks of ``block_pieces`` pieces; a block
leaves a few open sequences, so what blocks cost shrinks as 1 / block_pieces.
Blocks are dealt out by row position, hence no key can make one large. Pieces
of full length skip packing.

Defined results: a null or empty text has the end id alone (one piece of
length 1). Repeated rows are packed like any other row. An empty table gives an
empty result. Only ``doc_id`` and ``text`` are read; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, staged
from .tokens import ENCODE_BYTES, with_ends, worker_tokenizer
from .words import plain, sliced

#: Capacity of a sequence and the id that ends a document.
CAPACITY, END_ID = 1024, 2

#: Pieces that one packing block holds; rounds over sequences left open.
BLOCK_PIECES, ROUNDS = 1 << 16, 6


def piece_table(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece, start and length of all pieces of documents of these sizes, in order."""
    count = (sizes - 1) // capacity + 1
    doc = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    short = sizes - (count - 1) * capacity
    start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, short[doc], capacity)


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True, special_as_text: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if ``ids``, the piece's ids."""
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
    if ids:
        kinds["ids"] = "array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(vocabulary, True, "<u4", special_as_text=special_as_text)
        for batch in batches:
            keys, texts = batch.column(0), plain(batch.column(1))
            for a, b in sliced(texts, ENCODE_BYTES):
                full, at = with_ends(*tok.encode(texts.slice(a, b - a)), end_id)
                doc, piece, start, length = piece_table(np.diff(at), capacity)
                begin = at[doc] + start
                crc = [zlib.crc32(full[i:j]) for i, j in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                cols = [keys.take(pa.array(doc + a)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if ids:  # pieces follow each other as their ids do
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate((begin, at[-1:])), pa.int32()), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, list(kinds))

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each size; sizes are from 1 to ``capacity``, longest first by default."""
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    never = np.iinfo(np.int64).max
    used = 0
    for i in np.argsort(-sizes, kind="stable") if order is None else order:
        s = int(sizes[i])
        # Taking a sequence with gap g: N(g) falls by one and N(g - s) rises by one.
        change = np.where(count[s:capacity] > 0, 2 * (count[: capacity - s] - count[s:capacity]) + 2, never)
        if s < capacity and change[0] != never:
            change[0] -= 1  # a full sequence is counted nowhere
        k = int(change.argmin()) if s < capacity else 0
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if s < capacity and change[k] <= fresh:
            gap = s + k
            bins[i] = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, bins[i] = capacity, used
            used += 1
        offsets[i] = capacity - gap
        if gap > s:
            open_at[gap - s].append(int(bins[i]))
            count[gap - s] += 1
    return bins, offsets


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Longest first, each into the tightest open sequence."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        gap = s + int(some[s:].argmax())
        if some[gap]:
            bins[i] = open_at[gap].pop()
            some[gap] = bool(open_at[gap])
        else:
            gap, bins[i] = capacity, used
            used += 1
        offsets[i] = capacity - gap
        if gap > s:
            open_at[gap - s].append(int(bins[i]))
            some[gap - s] = True
    return bins, offsets


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squares over all sizes, then again over what stands in sequences left open.

    Full sequences stay. The others are emptied and packed anew, in turn in
    random and in falling order, and last by tightest fit; a round counts only
    if it takes no more sequences than before.
    """
    bins, offsets = sum_of_squares(sizes, capacity)
    rng = np.random.default_rng(len(sizes))
    for k in range(rounds + 1 if len(sizes) else 0):
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        loose = fill[bins] < capacity
        part = sizes[loose]
        if k == rounds:
            new, at = best_fit(part, capacity)
        else:
            new, at = sum_of_squares(part, capacity, rng.permutation(len(part)) if k % 2 == 0 else None)
        full = np.flatnonzero(fill == capacity)
        if len(part) and len(full) + new.max() + 1 <= len(fill):
            place = np.full(len(fill), -1)
            place[full] = np.arange(len(full))
            bins = place[bins]
            bins[loose] = new + len(full)
            offsets[loose] = at
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` must be a stored table, as it is read more than once.
    """
    full = pieces.where(F.col("length") == capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    blocks = cut(short.count(), block_pieces)
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bins, offsets = pack_block(rows.column("length").to_numpy(), capacity)
        rows = rows.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))
        return rows.select(names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    dealt = short.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    return full.select(*names).unionByName(dealt.groupBy("_block").applyInArrow(run, kinds))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True, block_pieces: int = BLOCK_PIECES, special_as_text: bool = True) -> DataFrame:
    """Tokenize and pack: one row per piece with its place, and its ids if wanted."""
    pieces = staged(tokenized_pieces(docs, vocabulary, capacity, end_id, ids, special_as_text))
    if not ids:
        return pack(pieces, capacity, block_pieces)
    where = pack(pieces.drop("ids"), capacity, block_pieces)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Repeated rows have equal ids, so one copy of the ids serves all their places.
    unique = pieces.dropDuplicates(keys).select("ids", *(F.col(k).alias(f"_{k}") for k in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return where.join(unique, on).select(*where.columns, "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id, ids (from offset 0 on), n_pieces."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.size("parts").alias("n_pieces"))
