"""Substring dedup with suffix automata of reference shards.

A window of ``window`` consecutive words is a repeat if its word sequence also
starts in a document with a smaller doc_id; every word inside such a window is
removed. Windows are judged on the input.

Each window has an anchor, its smallest hashed ``ANCHOR``-word sequence, so
equal windows have equal anchors wherever they stand. Anchors seen once can't
belong to a repeat. Around every other anchor a document has a passage: the
windows that share it. Passages go to the shard of their anchor, where a suffix
automaton over words is built from the shard's distinct passages. Each state
knows the smallest doc_id in which its sequences occur; streaming the passages
through it gives matching statistics, and at each match of ``window`` words or
more the smallest doc_id holding that very window. A shard of one passage needs
no automaton: all its windows have its smallest id.

Automata of the whole corpus would have no size bound, so they are not
broadcast: shards meet the passages that can match them instead (README has
the figures).

Scale: texts are stored once in chunks of about ``chunk_bytes``, bucketed by
chunk, and never shuffled; three passes read them, the last one cuts words but
needs no hashes. Anchors travel as a hash, a chunk and a count, once per chunk,
so a phrase of every document has a row per chunk. Passages are merged per
chunk and carry the places where they stand, so what is known of them returns
as places and ids. An anchor with more than ``shard_rows`` places is hot: its
windows become passages of their own with their own hash as key, so no shard
grows with a frequent phrase. Texts of a chunk are unpacked slice by slice;
nothing is collected.

Defined results: a null or empty text has no words and keeps nothing. A null
doc_id counts as larger than all others. Rows with equal doc_id don't repeat
each other. Extra columns are ignored, or kept by ``strip_repeats``; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, in_order, stored_chunks, unpacked
from .tokens import release
from .words import Words, plain

#: An automaton takes about 500 bytes a word, so one of SHARD_ROWS passages some 40 MB.
WINDOW, ANCHOR, SHARD_ROWS = 13, 5, 4_000
#: Distinct passages that a chunk holds as Python objects before they become Arrow rows.
HELD_PASSAGES = 100_000
_ID = "__folio_id"
_LAST = (1 << 63) - 1


class SuffixAutomaton:
    """Over sequences of words; each state knows the smallest id of those that hold it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [_LAST]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(_LAST)
        return len(self.link) - 1

    def _split(self, p: int, word: object, q: int) -> int:
        """The state of p's sequence plus ``word``: q, or a copy of q for its shorter sequences."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            if doc < self.least[last]:
                self.least[last] = doc

    def finish(self) -> None:
        """Pass smallest ids on to the suffixes that occur wherever a state does."""
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            up = self.link[s]
            if up >= 0 and self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def matching(self, words: list, window: int) -> list[int]:
        """For each window of ``words``: the smallest id that holds it, or the largest number if none does."""
        state = size = 0
        out = []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            if i + 1 >= window:
                if size < window:
                    out.append(_LAST)
                    continue
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                    size = self.length[state]
                out.append(self.least[state])
        return out


def _anchor_rows(stored: DataFrame, window: int, anchor: int) -> DataFrame:
    """h, chunk, places: the anchors of every stored slice, and in how many places they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), strict=True):
                _, _, h = Words(rows.column("text")).anchors(window, anchor)
                if len(h):
                    h = np.sort(h)
                    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                    places = np.diff(np.concatenate((head, [len(h)])))
                    yield pa.RecordBatch.from_arrays([pa.array(h[head]), pa.array(np.full(len(head), chunk)), pa.array(places)], ["h", "chunk", "places"])

    return stored.select("chunk", "rows").mapInArrow(run, "h long, chunk long, places long")


def _marks(anchors: DataFrame, shard_rows: int) -> DataFrame:
    """chunk, h, hot: anchors that stand in two places or more, in every chunk that has them."""
    places = F.sum("places").over(Window.partitionBy("h"))  # a row for each slice that has h
    return anchors.withColumn("n", places).where("n > 1").select("h", "chunk", (F.col("n") > shard_rows).alias("hot")).distinct()


def _passage_rows(stored: DataFrame, marks: DataFrame, window: int, anchor: int) -> DataFrame:
    """Passages around shared anchors: h, chunk, windows, passage, smallest and largest id in the chunk, places in it.

    A place is the number of the passage's first word in the chunk. Around a hot
    anchor every window is a passage of its own, with its own hash as h.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        shared = np.sort(right.column("h").to_numpy())
        hot = np.sort(right.filter(right.column("hot")).column("h").to_numpy())
        out: list[pa.RecordBatch] = []
        found: dict[bytes, int] = {}
        keys: list[int] = []
        spans: list[int] = []
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # passage, id, place

        def flush() -> None:
            if found:
                which, ids, places = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.argsort(which, kind="stable")
                head = np.searchsorted(which[order], np.arange(len(found)))
                at = pa.py_buffer((np.concatenate((head, [len(order)])) * 4).astype(np.int32))
                columns = [
                    pa.array(keys, pa.int64()), pa.array(np.full(len(found), key[0].as_py())), pa.array(spans, pa.int32()), pa.array(list(found), pa.binary()),
                    pa.array(np.minimum.reduceat(ids[order], head)), pa.array(np.maximum.reduceat(ids[order], head)),
                    pa.Array.from_buffers(pa.binary(), len(found), [None, at, pa.py_buffer(places[order].astype(np.uint32))]),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, schema=_PASSAGE))
                found.clear(), keys.clear(), spans.clear(), hits.clear()

        before = 0
        for rows in unpacked(in_order(left)) if len(shared) else ():
            words = Words(rows.column("text"))
            a, b, h = words.anchors(window, anchor)
            hit = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
            a, b, h = a[hit], b[hit], h[hit]
            if len(hot):
                single = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                count = (b - a - window + 1)[single]
                first = np.repeat(a[single] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                cold = ~single
                a, b, h = np.concatenate((a[cold], first)), np.concatenate((b[cold], first + window)), np.concatenate((h[cold], np.zeros(len(first), np.int64)))
                single = np.repeat([False, True], [cold.sum(), len(first)]).tolist()
            else:
                single = [False] * len(a)
            ids = rows.column(_ID).to_numpy(zero_copy_only=False)[np.searchsorted(words.first, a, side="right") - 1]
            text = words.norm.tobytes()
            which = np.empty(len(a), np.int64)
            for k, (i, j, own, span, alone) in enumerate(zip(words.at[a].tolist(), (words.at[b] - 1).tolist(), h.tolist(), (b - a - window + 1).tolist(), single, strict=True)):
                passage = text[i:j]
                at = found.get(passage)
                if at is None:
                    at = found[passage] = len(found)
                    keys.append(xxhash.xxh3_64_intdigest(passage, 13) - (1 << 63) if alone else own)
                    spans.append(span)
                which[k] = at
            hits.append((which, ids, a + before))
            before += len(words)
            if len(found) >= HELD_PASSAGES:
                flush()
        flush()
        return pa.Table.from_batches(out, _PASSAGE)

    kinds = "h long, chunk long, windows int, passage binary, least long, most long, places binary"
    return stored.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, kinds)


_PASSAGE = pa.schema([("h", pa.int64()), ("chunk", pa.int64()), ("windows", pa.int32()), ("passage", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("places", pa.binary())])


def window_ids(passages_: dict[bytes, int], window: int) -> dict[bytes, list[int]]:
    """For each window of each passage the smallest id that holds it; one number if it is the same for all.

    ``passages_``: the passages of one anchor, a reference shard, with their smallest ids.
    """
    if len(passages_) == 1:
        return {p: [least] for p, least in passages_.items()}
    automaton = SuffixAutomaton()
    split = {p: p.split(b" ") for p in passages_}
    for p, words in split.items():
        automaton.add(words, passages_[p])
    automaton.finish()
    out = {}
    for p, words in split.items():
        ids = automaton.matching(words, window)
        out[p] = ids[:1] if ids.count(ids[0]) == len(ids) else ids
    return out


def _known(rows: DataFrame, parts: int, window: int) -> DataFrame:
    """chunk, windows, places, ids for the passages of a chunk that smaller ids repeat."""
    shape = pa.schema([("chunk", pa.int64()), ("windows", pa.int32()), ("places", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def judged(table: pa.Table) -> pa.RecordBatch:
        """Whole shards, in order of h."""
        table = table.combine_chunks()
        h, least, most = (table.column(c).to_numpy() for c in ("h", "least", "most"))
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.concatenate((head, [len(h)])))
        code = table.column("passage").combine_chunks().dictionary_encode().indices.to_numpy()
        low = np.repeat(np.minimum.reduceat(least, head), size)
        one = np.minimum.reduceat(code, head) == np.maximum.reduceat(code, head)
        plainly = np.flatnonzero(np.repeat(one, size) & (low < most))
        rows_, ids, count = [plainly], [low[plainly]], [np.ones(len(plainly), np.int64)]
        for a, n in zip(head[~one].tolist(), size[~one].tolist(), strict=True):
            shard: dict[bytes, int] = {}
            texts = table.column("passage").slice(a, n).to_pylist()
            for p, k in zip(texts, least[a : a + n].tolist(), strict=True):
                shard[p] = min(k, shard.get(p, _LAST))
            found = window_ids(shard, window)
            for i, (p, k) in enumerate(zip(texts, most[a : a + n].tolist(), strict=True), a):
                if min(found[p]) < k:
                    rows_.append([i])
                    ids.append(found[p])
                    count.append([len(found[p])])
        at, ids, count = (np.concatenate(x).astype(np.int64) for x in (rows_, ids, count))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids))
        out = table.select(["chunk", "windows", "places"]).take(pa.array(at)).combine_chunks().to_batches()
        return pa.RecordBatch.from_arrays([*(out[0].columns if out else [pa.array([], f.type) for f in shape][:3]), lists], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column(0)[-1].as_py() != held[0].column(0)[0].as_py():  # the last shard may go on
                table = pa.Table.from_batches(held)
                last = int(np.searchsorted(table.column("h").to_numpy(), batch.column(0)[-1].as_py()))
                yield judged(table.slice(0, last))
                held = table.slice(last).to_batches()
        if held:
            yield judged(pa.Table.from_batches(held))

    shards = rows.repartition(parts, "h").sortWithinPartitions("h")
    return shards.mapInArrow(run, "chunk long, windows int, places binary, ids array<long>")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Stored chunks of ``docs`` with an id (null last), and per chunk the passages whose windows occur in smaller ids."""
    docs = docs.withColumn(_ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    stored, parts, _ = stored_chunks(docs, chunk_bytes)
    marks = _marks(_anchor_rows(stored, window, anchor), shard_rows)
    return stored, _known(_passage_rows(stored, marks, window, anchor), parts, window)


class Known:
    """What smaller ids repeat in a chunk, by place."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        table = table.combine_chunks()
        places, lists = (pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("places", "ids"))
        at = np.frombuffer(b"".join(places.to_pylist()), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(places)), pc.binary_length(places).to_numpy(zero_copy_only=False) // 4)
        order = np.argsort(at, kind="stable")
        self.at, self.row = at[order], row[order]
        self.size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin, self.flat = np.cumsum(self.size) - self.size, lists.flatten().to_numpy()
        self.windows = table.column("windows").to_numpy()

    def covered(self, ids: np.ndarray, first: np.ndarray, before: int) -> np.ndarray:
        """Which words of a slice stand in a window that a smaller id holds.

        ``ids``: each document's id; ``first``: its first word, and the number
        of all words; ``before``: words of the chunk before the slice.
        """
        edge = np.zeros(int(first[-1]) + 1, np.int64)
        some = slice(*np.searchsorted(self.at, [before, before + first[-1]]))
        at, row = self.at[some] - before, self.row[some]
        own = ids[np.searchsorted(first, at, side="right") - 1]
        alike = self.size[row] == 1
        hit = alike & (self.flat[self.begin[row]] < own) if len(row) else alike
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + self.windows[row[hit]] + self.window - 1, -1)
        many = np.flatnonzero(~alike)
        n = self.size[row[many]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = self.flat[np.repeat(self.begin[row[many]], n) + step] < np.repeat(own[many], n)
        start = (np.repeat(at[many], n) + step)[hit]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _applied(found: tuple[DataFrame, DataFrame], kinds: str, make: Callable, window: int) -> DataFrame:
    """Run ``make(rows, words, covered words)`` over every slice of every chunk."""
    stored, known = found

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        seen, before, out = Known(right, window), 0, []
        for rows in unpacked(in_order(left)):
            words = Words(rows.column("text"))
            covered = seen.covered(rows.column(_ID).to_numpy(zero_copy_only=False), words.first, before)
            before += len(words)
            out.append(make(rows, words, covered))
        return pa.concat_tables(out)

    return stored.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, kinds)


def dedup_digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row."""
    docs = docs.select("doc_id", "text")
    key = docs.schema["doc_id"].dataType.simpleString()

    def make(rows: pa.RecordBatch, words: Words, covered: np.ndarray) -> pa.Table:
        text, at = words.kept(covered)
        kept = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        removed = np.concatenate(([0], np.cumsum(covered)))[words.first]
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_words": pa.array(np.diff(words.first)),
            "n_removed": pa.array(np.diff(removed)), "kept_sha256": pa.array(kept, pa.string()),
        })

    return _applied(repeats(docs, window, anchor, **sizes), f"doc_id {key}, n_words long, n_removed long, kept_sha256 string", make, window)


def cut_text(raw: bytes, start: np.ndarray, covered: np.ndarray) -> str:
    """A text without the covered words and the white space after each of them; ``start``: where words begin."""
    start = np.concatenate((start, [len(raw)]))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))).reshape(-1, 2)
    out, at = [], 0
    for a, b in edge:
        out.append(raw[at : start[a]])
        at = start[b]
    return b"".join([*out, raw[at:]]).decode()


def strip_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, **sizes: int) -> DataFrame:
    """The rows of ``docs`` with repeats cut out of ``text``; rows left without a word go.

    Other columns stay as they are, so counts taken of the old text (``n_chars``) do too.
    """
    columns = docs.columns

    def make(rows: pa.RecordBatch, words: Words, covered: np.ndarray) -> pa.Table:
        hit = np.diff(np.concatenate(([0], np.cumsum(covered)))[words.first])
        new = rows.column("text")
        if hit.any():
            new, raw = new.to_pylist(), words.raw.tobytes()
            for k in np.flatnonzero(hit).tolist():
                a, b, i, j = *words.cut[k : k + 2].tolist(), *words.first[k : k + 2].tolist()
                new[k] = cut_text(raw[a:b], words.start[i:j] - a, covered[i:j])
            new = pa.array(new, rows.schema.field("text").type)
        kept = (hit == 0) | (hit < np.diff(words.first))
        table = pa.Table.from_batches([rows])
        return table.set_column(table.schema.get_field_index("text"), "text", new).select(columns).filter(pa.array(kept))

    return _applied(repeats(docs, window, anchor, **sizes), docs.schema, make, window)
