"""Language-model scoring with a hashed maximum-entropy model.

The most frequent training words are outputs of their own, about OUTPUTS times
the square root of the number of distinct words, so they grow with the corpus.
All others share one output, inside which a word has its smoothed share of
training counts. Outputs stand in a tree of classes: a node has up to SLOTS
children, half of them outputs and half of them classes (in the lowest level
outputs alone), the more frequent outputs nearer to the top. A word's
probability is the product of the softmaxes at the nodes on its way. Each
softmax starts from the training counts and adds hashed feature weights: the
word before, the word before that (skip) and, at the top, the pair of both.
Features are hashed from the words themselves: a word without an output is a
context of its own from CONTEXT_COUNT training occurrences on, and by its last
ENDING bytes below. A text's score is the log10 probability of its words and one end.

Counts are exact and cover all training documents. Training takes ROUNDS
rounds, each over its share of all training documents: every task takes
minibatch gradient steps from the same start, and their weight changes are
averaged by how often each row of weights was used (parameter mixing), in two
levels by Spark.

Scale: texts are stored once in chunks bucketed by chunk and never shuffled.
Word counts are merged per chunk, then per word, and return to the chunks that
use them by a join, so no vocabulary is broadcast. Chunks then store each text
as numbers of outputs and hashes of contexts, which training and scoring read.
What is broadcast: the tree, at most OUTPUTS * sqrt(distinct words) entries,
and the hashed weights, 4 to 8 * sqrt(training tokens) rows of SLOTS numbers
and at most MOST_ROWS (16 MB).

Defined results: a null or empty text has the end alone. Without training rows
every token is unknown and the model is uniform over its one output. Repeated
rows get equal scores. A null doc_id counts as empty text in the fold. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, in_order, stored_chunks, unpacked
from .common import cut, fold, staged
from .tokens import release, with_ends
from .words import Words, bytes_of, lane_hashes

#: Children of a node; outputs by the square root of distinct words; most rows of hashed weights.
SLOTS, OUTPUTS, MOST_ROWS = 32, 3, 1 << 17
#: Training occurrences from which a word without an output is a context of its own; bytes of an ending.
CONTEXT_COUNT, ENDING = 64, 2
TRAIN_BYTES, BATCH, RATE, ROUNDS = 64_000_000, 8192, 0.3, 2
#: Least and most tokens of a minibatch; between them it has as many as there are rows of weights.
LEAST_BATCH, MOST_BATCH = 1024, 1 << 15
END, REST = 0, 1
#: Stored tokens: an output's number, or this bit and 31 bits of hash of a word without one or of its ending.
_RARE = np.uint32(1 << 31)
_LOG10 = 1 / math.log(10)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def tree(outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For outputs by falling frequency: depth, and per level the node and the slot on the way; the number of nodes."""
    half = SLOTS // 2
    levels = 1
    while sum(half**d for d in range(1, levels)) + half ** (levels - 1) * SLOTS < outputs:
        levels += 1
    depth = np.empty(outputs, np.int64)
    node, slot = np.zeros((levels, outputs), np.int64), np.zeros((levels, outputs), np.int64)
    first = [sum(half**d for d in range(k)) for k in range(levels + 1)]  # number of a level's first node
    at = 0
    for k in range(levels):
        fan = SLOTS if k == levels - 1 else half
        n = min(outputs - at, half**k * fan)
        own, place = np.arange(n) // fan, np.arange(n) % fan
        depth[at : at + n] = k + 1
        for up in range(k, -1, -1):
            node[up, at : at + n], slot[up, at : at + n] = first[up] + own, place
            own, place = own // half, half + own % half
        at += n
    return depth, node, slot, first[levels]


def _rows_of(node: np.ndarray, context: np.ndarray, kind: np.uint64, rows: int) -> np.ndarray:
    x = (context + kind) * _A ^ (node.astype(np.uint64) + kind) * _B
    x ^= x >> np.uint64(29)
    return ((x * _C) >> np.uint64(34)).astype(np.int64) & (rows - 1)


@dataclass
class MaxEnt:
    """Corpus counts, the tree of outputs with their counts, and hashed weights."""

    counts: np.ndarray  # of END, REST and the words with an output
    tokens: int
    distinct: int
    rest_tokens: int
    rest_distinct: int
    rows: int
    weights: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.depth, self.node, self.slot, nodes = tree(len(self.counts))
        share = np.zeros((nodes, SLOTS))
        for k in range(len(self.node)):
            own = self.depth > k
            np.add.at(share, (self.node[k, own], self.slot[k, own]), np.maximum(self.counts[own], 0.5))
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        self.bias = np.log(np.maximum(share, 1e-13)).astype(np.float32)
        if self.weights is None:
            self.weights = np.zeros((self.rows, SLOTS), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__

    @staticmethod
    def contexts(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outputs of stored tokens, and hashes of the two tokens before each; ``start``: first tokens of texts."""
        h = ids.astype(np.uint64) * _C
        end = np.uint64(END) * _C
        one, two = np.concatenate(([end], h[:-1])), np.concatenate(([end, end], h[:-2]))[: len(h)]
        one[start] = end
        two[start] = end
        two[start[start + 1 < len(h)] + 1] = end
        return np.where(ids >= _RARE, REST, ids).astype(np.int64), one, two

    def steps(self, y: np.ndarray, one: np.ndarray, two: np.ndarray, learn: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, list[np.ndarray]]]]:
        """Natural log probabilities; and, to learn from, per level what is left of each softmax and the rows it used."""
        logp, left = np.zeros(len(y)), []
        one_sum = np.ones(SLOTS, np.float32)
        depth = self.depth[y]
        for k in range(int(depth.max(initial=0))):
            some = np.flatnonzero(depth > k)
            own, a, b = y[some], one[some], two[some]
            node, slot = self.node[k][own], self.slot[k][own]
            used = [_rows_of(node, a, np.uint64(1), self.rows), _rows_of(node, b, np.uint64(2), self.rows)]
            if k == 0:
                used.append(_rows_of(node, a * _B ^ b, np.uint64(3), self.rows))
            s = self.weights.take(used[0], axis=0)
            for r in used[1:]:
                s += self.weights.take(r, axis=0)
            s += self.bias.take(node, axis=0)
            np.exp(s, out=s)
            total = s @ one_sum
            every = np.arange(len(some))
            logp[some] += np.log(s[every, slot] / total, dtype=np.float64)
            if learn:
                s *= (-1 / total)[:, None]
                s[every, slot] += 1
                left.append((s, used))
        return logp, left

    def train(self, ids: np.ndarray, start: np.ndarray, held: np.ndarray, used: np.ndarray) -> None:
        """Minibatch steps; ``held`` keeps squared gradients by row for adaptive rates, ``used`` counts uses of rows."""
        y, one, two = self.contexts(ids, start)
        size = min(MOST_BATCH, max(LEAST_BATCH, self.rows))
        for a in range(0, len(y), size):
            b = slice(a, a + size)
            _, left = self.steps(y[b], one[b], two[b], True)
            # Column by column over contiguous numbers; level 0 comes first and alone has the pair.
            columns = np.ascontiguousarray(np.concatenate([g for g, _ in left]).T, np.float64)
            before, skip, pair = np.concatenate([u[0] for _, u in left]), np.concatenate([u[1] for _, u in left]), left[0][1][2]
            grad = np.empty((SLOTS, self.rows), np.float32)
            for k, g in enumerate(columns):
                grad[k] = np.bincount(before, g, self.rows) + np.bincount(skip, g, self.rows) + np.bincount(pair, g[: len(pair)], self.rows)
            used += np.bincount(np.concatenate((before, skip, pair)), minlength=self.rows)
            held += np.einsum("ij,ij->j", grad, grad) / SLOTS
            grad *= RATE / np.sqrt(held + 1)
            self.weights += grad.T
        np.clip(self.weights, -8, 8, out=self.weights)

    def score(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """log10 probabilities of texts, without those of words within REST."""
        y, one, two = self.contexts(ids, start)
        logs = [self.steps(y[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH], False)[0] for a in range(0, len(y), BATCH)]
        return np.add.reduceat(np.concatenate(logs), start) * _LOG10 if len(y) else np.empty(0)


def _slice_words(rows: pa.RecordBatch) -> tuple[Words, pa.Array, np.ndarray]:
    """The words of a slice, the distinct ones (with a blank behind) and which each is."""
    words = Words(rows.column("text"), lower=True)
    coded = words.array().dictionary_encode()
    return words, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _vocabulary(stored: DataFrame) -> DataFrame:
    """chunk, word, n: every word of a chunk, with n = 0 where only texts not learned from use it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        last, words, counts = None, [], []

        def merged() -> pa.RecordBatch:
            coded = pa.concat_arrays(words).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.concatenate(counts)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), last)), coded.dictionary, pa.array(n)], ["chunk", "word", "n"])

        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), strict=True):
                if words and chunk != last:
                    yield merged()
                    words, counts = [], []
                last = chunk
                own, distinct, which = _slice_words(rows)
                if len(own):
                    learn = np.repeat(rows.column("_train").to_numpy(zero_copy_only=False), np.diff(own.first))
                    words.append(distinct)
                    counts.append(np.bincount(which, learn, len(distinct)))
        if words:
            yield merged()

    return stored.select("chunk", "rows").mapInArrow(run, "chunk long, word binary, n long")


def _numbered(stored: DataFrame, back: DataFrame, model: MaxEnt, key: str) -> DataFrame:
    """doc_id, _train, n_tokens, n_known, base_score, rest and ids (stored tokens) of every text.

    ``rest``: log10 of the shares of its rare words within REST.
    """
    shared = stored.sparkSession.sparkContext.broadcast((int(model.counts[END]), math.log(model.tokens + model.distinct + 1), math.log(model.rest_tokens + model.rest_distinct + 1)))
    names = ["doc_id", "_train", "n_tokens", "n_known", "base_score", "rest", "ids"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        ends, below, rest_below = shared.value
        slices, distinct, at = [], [], [0]
        for rows in unpacked(in_order(left)):
            words, own, which = _slice_words(rows)
            slices.append((rows.select(["doc_id", "_train"]), words.first, which))
            distinct.append(own)
            at.append(at[-1] + len(own))
        distinct = pa.concat_arrays(distinct)
        found = pc.index_in(distinct, value_set=right.column("word"))
        place = pc.fill_null(found, right.num_rows).to_numpy(zero_copy_only=False)
        count = np.append(right.column("c").to_numpy(), 0)[place]
        code = np.append(pc.fill_null(right.column("code"), -1).to_numpy(), -1)[place]
        raw, begin = bytes_of(distinct)
        length = np.where(count >= CONTEXT_COUNT, np.diff(begin), np.minimum(np.diff(begin), ENDING + 1))  # each has a blank behind
        h = lane_hashes(np.concatenate((raw, np.zeros(8, np.uint8))), begin[1:] - length, length) >> np.uint64(33)
        token = np.where(code < 0, h.astype(np.uint32) | _RARE, code.astype(np.uint32))
        logs = np.log(count + 1.0)
        rare = np.where(code < 0, logs - rest_below, 0.0)
        out = []
        for (rows, first, which), before in zip(slices, at[:-1], strict=True):
            which = which + before
            ids, bounds = with_ends(token[which], first, END)
            n = np.diff(bounds)
            sums = [np.add.reduceat(with_ends(x[which], first, end)[0], bounds[:-1]) for x, end in ((logs, math.log(ends + 1.0)), (rare, 0.0), ((count > 0).astype(np.int64), int(ends > 0)))]
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
            out.append(pa.table([rows.column(0), rows.column(1), pa.array(n), pa.array(sums[2]), pa.array((sums[0] - n * below) * _LOG10), pa.array(sums[1] * _LOG10), packed], names))
        return pa.concat_tables(out)

    kinds = f"doc_id {key}, _train boolean, n_tokens long, n_known long, base_score double, rest double, ids binary"
    return stored.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, kinds)


def _token_runs(column: pa.Array, most: int = 16 * BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stored tokens of about ``most`` at a time, whole texts, and where each text begins."""
    raw, at = bytes_of(column)
    at = at // 4
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield np.frombuffer(raw[at[a] * 4 : at[b] * 4].tobytes(), "<u4"), at[a:b] - at[a]
        a = b


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum packed float vectors by key."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("vec")[0].as_py()) // 4, np.float32)
        for v in table.column("vec"):
            total += np.frombuffer(v.as_buffer(), np.float32)
        return pa.table({k: table.column(k).slice(0, 1) for k in keys} | {"vec": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", vec binary")


def train(texts: DataFrame, model: MaxEnt, size: int, train_bytes: int = TRAIN_BYTES) -> MaxEnt:
    """One round: local gradient steps over all rows of ``texts`` (ids) and one average of the changes."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    parts = cut(size, train_bytes)
    pieces = max(1, model.rows // 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        base = shared.value
        own = MaxEnt(base.counts, base.tokens, base.distinct, base.rest_tokens, base.rest_distinct, base.rows, base.weights.copy())
        held, used, part = np.zeros(own.rows, np.float32), np.zeros(own.rows, np.float32), 0
        for batch in batches:
            part = batch.column(1)[0].as_py() if batch.num_rows else part
            for ids, start in _token_runs(batch.column(0)):
                own.train(ids, start, held, used)
        if used.any():
            flat = np.concatenate(((own.weights - base.weights) * used[:, None], used[:, None]), axis=1)
            for k, piece in enumerate(np.array_split(flat, pieces)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["piece", "part", "vec"])

    changes = texts.select("ids").coalesce(parts).withColumn("_p", F.spark_partition_id()).mapInArrow(run, "piece int, part int, vec binary")
    fan = max(1, math.isqrt(parts))
    level = _summed(changes.withColumn("part", (F.col("part") % fan).cast("int")), ["piece", "part"])
    found = sorted(_summed(level, ["piece"]).collect(), key=lambda r: r["piece"])  # as large as the model
    if found:
        flat = np.concatenate([np.frombuffer(r["vec"], np.float32) for r in found]).reshape(-1, SLOTS + 1)
        model.weights = model.weights + flat[:, :SLOTS] / np.maximum(flat[:, SLOTS:], 1)
    return model


def fit(counts: DataFrame, ends: int) -> tuple[MaxEnt, DataFrame]:
    """An untrained model of a table of (word, c), and the table of words with an output and its code."""
    known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    outputs = max(SLOTS, int(OUTPUTS * math.sqrt(known["v"]))) - 2
    top = counts.orderBy(F.desc("c"), "word").limit(outputs).collect()
    in_top = sum(r["c"] for r in top)
    rows = 1 << max(8, math.ceil(math.log2(8 * math.sqrt(known["n"] + ends + 1))) - 1)
    own = np.array([ends, known["n"] - in_top, *(r["c"] for r in top)], np.float64)
    model = MaxEnt(own, known["n"] + ends, known["v"] + (ends > 0), known["n"] - in_top, known["v"] - len(top), min(MOST_ROWS, rows))
    codes = counts.sparkSession.createDataFrame([(r["word"], k + 2) for k, r in enumerate(top)], "word binary, code int")
    return model, codes


def score_documents(docs: DataFrame, held_out_of: int = 7, held_out: int = 2, chunk_bytes: int = CHUNK_BYTES, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()
    lean = docs.select("doc_id", "text").withColumn("_train", fold(F.col("doc_id"), held_out_of) != held_out)
    stored, _, size = stored_chunks(lean, chunk_bytes)
    vocabulary = staged(_vocabulary(stored))
    counts = staged(vocabulary.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    model, codes = fit(counts, docs.where(fold(F.col("doc_id"), held_out_of) != held_out).count())
    coded = counts.join(F.broadcast(codes), "word", "left")  # OUTPUTS * sqrt(distinct words) rows at most
    back = vocabulary.select("chunk", "word").join(coded, "word").select("chunk", "word", "c", "code")
    texts = staged(_numbered(stored, back, model, key))
    if model.counts[END]:
        for k in range(ROUNDS):
            model = train(texts.where(F.col("_train") & (F.pmod(F.xxhash64("ids"), F.lit(ROUNDS)) == k)), model, size // ROUNDS, train_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                score = np.concatenate([m.score(ids, start) for ids, start in _token_runs(batch.column(6))]) + batch.column(5).to_numpy()
                cols = [batch.column(0), pc.invert(batch.column(1)), batch.column(2), batch.column(3), pa.array(np.full(len(score), m.tokens)), batch.column(4), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.mapInArrow(run, kinds)
