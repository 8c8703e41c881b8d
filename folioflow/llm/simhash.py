"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of the text's shingle hashes
have it. Fingerprints link at ``distance`` or fewer differing bits, and linked
documents form components.

Index: fingerprints are sorted by Gray rank, in which neighbours share most
bits. Nodes over runs of neighbours hold the bits that all of them share
(mask and pattern); a parent takes the bits common to its children out of them,
so a search adds up differences from the top down and leaves a whole group as
soon as the sum is too large. If the sum and all bits that vary below a node
stay within the distance, the whole group is linked at once.

Distribution: of ``distance + 1`` blocks of bits, two linked fingerprints agree
in one at least. Each distinct fingerprint is sent once per block, with that
block moved to the top, to the group of its leading bits; a group's index
demands equality in that block. A group above ``group_rows`` is not indexed but
sent again by that block and, in turn, each of the remaining bits' blocks; this
ends when the bits left can't name more fingerprints than a group may hold. So
groups are bounded and no link is lost. A group emits a spanning forest of its
links, never its pairs.

Copies: equal fingerprints are merged before indexing (a map-side minimum of
doc_id), so a third of all rows in one group of copies is one index entry.

Defined results: a text without words has fingerprint zero and is linked like
any other. Nulls count as empty texts. Repeated rows get equal results; rows
with a null doc_id get a fingerprint and a component like others, and never
give a component its name unless all members are null. Extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, staged
from .components import Forest, components
from .tokens import release, slices

#: Words in a shingle, hash seed, bits in which linked fingerprints may differ.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints that one index may hold, and that groups hold on average.
GROUP_ROWS, GROUP_MEAN = 1 << 16, 1 << 12
#: Near copies by similarity: words in a shingle, least Jaccard similarity of shingle sets,
#: sample tables and their shingles, tables that are tested first.
COPY_SHINGLE, SIMILARITY, TABLES, SAMPLE, FIRST_TABLES = 5, 0.8, 16, 3, 4
#: Texts and shingles that one test of all pairs holds on average, texts in a tile, columns multiplied at once.
TEST_ROWS, TEST_SHINGLES, TILE, COLUMNS = 1 << 12, 1 << 21, 128, 1 << 14
#: Children of a node; rows of a search that run at once.
FAN, FRONT = 8, 1 << 18
#: Bytes of a text that are cut into words at once.
PART = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of all shingles, repeats included; A-Z count as a-z.

    Words are taken from about PART bytes at a time; the last ones go on to the next part.
    """
    data = (text or "").encode().lower()
    h = xxhash.xxh64_intdigest
    parts: list[np.ndarray] = []
    words: list[bytes] = []
    end = 0
    while end < len(data):
        begin, blank = end, _BLANK.search(data, end + PART)
        end = blank.start() if blank else len(data)
        words += data[begin:end].split()
        if len(words) >= shingle:
            rows = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            parts.append(np.fromiter((h(x, seed) for x in rows), np.uint64, len(words) - shingle + 1))
            words = words[len(words) - shingle + 1 :]
    if not parts:
        return np.array([h(b" ".join(words), seed)] if words else [], np.uint64)
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorting is much faster than np.unique's table for hashes."""
    hashes = np.sort(hashes)
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))] if len(hashes) else hashes


def fingerprint_of(hashes: np.ndarray) -> int:
    """The majority of each bit."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[a : a + (1 << 14)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, tables: int = 0, size: int = SAMPLE) -> DataFrame:
    """doc_id, fp (64 bits as a long) and, if ``tables`` are asked for, sid, size and samples.

    With ``tables`` all of them are of distinct shingles. ``sid``: a hash of the
    whole set, ``size``: its shingles. ``samples``: for each table a key of the
    ``size`` shingles that come first in an order of that table's own.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    odd = np.random.default_rng(2).integers(1, 1 << 63, max(1, tables), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps, sids, sizes, held = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), shingle, seed)
                if tables:
                    hashes = distinct(hashes)
                    sids.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    own = []
                    for m in odd:
                        mixed = hashes * m
                        mixed ^= mixed >> np.uint64(29)
                        first = mixed if len(mixed) <= size else np.partition(mixed, size)[:size]
                        own.append(int(np.bitwise_xor.reduce(np.sort(first) * np.uint64(0x9E3779B97F4A7C15))) if len(first) else 0)
                    held.append(np.array(own, np.uint64).view(np.int64))
                fps.append(fingerprint_of(hashes))
            cols = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))]
            if tables:
                cols += [pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "sid", "size", "samples"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, fp long" + ", sid long, size long, samples array<long>" * bool(tables))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Positions of 64-bit words in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class GrayIndex:
    """The hierarchical index over distinct fingerprints in Gray order.

    ``exact``: a mask of bits in which links may not differ.
    """

    def __init__(self, values: np.ndarray, exact: int = 0, distance: int = DISTANCE):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        self.exact, self.distance = np.uint64(exact), distance
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        every, some = self.values, self.values  # bits set in all and in any of a node's members
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # mask, pattern, bits that vary below
        shared = [np.full(len(values), ones)]
        patterns = [self.values]
        while len(every) > 1:
            at = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            shared.append(~(every ^ some))
            patterns.append(every)
        for k in range(len(shared)):
            mask = shared[k]
            if k + 1 < len(shared):  # what the parent has is taken out
                mask = mask & ~np.repeat(shared[k + 1], FAN)[: len(mask)]
            self.levels.append((mask, patterns[k], popcount(~shared[k])))

    def _span(self, level: int, node: np.ndarray) -> np.ndarray:
        return np.minimum((node + 1) * FAN**level, len(self.values))

    def link(self) -> np.ndarray:
        """Components of all links inside the index: for each value its root's position."""
        n = len(self.values)
        forest = Forest(n)
        if n < 2:
            return forest.flatten()
        # Whole nodes of mutually close members are joined when the index is built.
        for level in range(1, len(self.levels)):
            _, _, vary = self.levels[level]
            differs = (~self._shared(level) & self.exact) == 0
            near = np.flatnonzero((vary <= self.distance) & differs)
            if not len(near):
                break
            size = FAN**level
            member = (near[:, None] * size + np.arange(1, size)).ravel()
            head = np.repeat(near * size, size - 1)
            inside = member < n
            forest.join(head[inside], member[inside])
        top = len(self.levels) - 1
        step = max(1, FRONT // FAN)
        for a in range(0, n, step):
            query = np.arange(a, min(n, a + step))
            self._search(forest, query, np.zeros(len(query), np.int64), np.zeros(len(query), np.int64), top)
        return forest.flatten()

    def _shared(self, level: int) -> np.ndarray:
        mask = self.levels[level][0].copy()
        for up in range(level + 1, len(self.levels)):
            mask |= self.levels[up][0][np.arange(len(mask)) // FAN ** (up - level)]
        return mask

    def _search(self, forest: Forest, query: np.ndarray, node: np.ndarray, sums: np.ndarray, level: int) -> None:
        """Go on from (query, node) pairs whose parents are within the distance."""
        mask, pattern, vary = self.levels[level]
        off = (self.values[query] ^ pattern[node]) & mask[node]
        sums = sums + popcount(off)
        go = (sums <= self.distance) & ((off & self.exact) == 0) & (self._span(level, node) > query + 1)
        query, node, sums = query[go], node[go], sums[go]
        if not len(query):
            return
        if level == 0:
            forest.join(query, node)
            return
        if self.distance >= 1:
            # Whole groups within the distance, whatever their members vary in. Their members link to the query.
            whole = (sums + vary[node] <= self.distance) & (self.exact == 0)
            if whole.any():
                q, k = query[whole], node[whole]
                size = FAN**level
                forest.join(q, k * size)
                inner = np.minimum(k * size + size - 1, len(self.values) - 1)
                forest.join(q, inner)
                close = vary[k] <= self.distance  # already one component
                if not close.all():
                    for qi, ki in zip(q[~close], k[~close], strict=True):
                        members = np.arange(ki * size, min(len(self.values), (ki + 1) * size))
                        forest.join(np.full(len(members), qi), members)
                query, node, sums = query[~whole], node[~whole], sums[~whole]
        # Children are made for a part of the pairs at a time, so no level holds more than FRONT rows.
        step = max(1, FRONT // FAN)
        for a in range(0, len(query), step):
            child = (node[a : a + step, None] * FAN + np.arange(FAN)).ravel()
            inside = np.flatnonzero(child < len(self.levels[level - 1][0]))
            own = a + inside // FAN
            self._search(forest, query[own], child[inside], sums[own], level - 1)


def block_widths(bits: int, blocks: int) -> list[int]:
    """``blocks`` nearly equal widths that sum to ``bits``."""
    return [bits // blocks + (k < bits % blocks) for k in range(blocks)]


def rotated(values: np.ndarray, fixed: int, widths: list[int], block: int) -> np.ndarray:
    """Move one block of the bits below the ``fixed`` top ones up beside those."""
    left = 64 - fixed
    low = values & np.uint64((1 << left) - 1) if left < 64 else values
    top = values ^ low
    before, width = sum(widths[:block]), widths[block]
    after = left - before - width
    part = low >> np.uint64(after) & np.uint64((1 << width) - 1)
    first = low >> np.uint64(after + width)
    last = low & np.uint64((1 << after) - 1)
    return top | part << np.uint64(left - width) | first << np.uint64(after) | last


def _spread(rows: DataFrame, fixed: int, widths: list[int], lead: int) -> DataFrame:
    """Send each row (path, v, fp) once per block; g names its group: path and leading bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(len(widths)):
                new = rotated(v, fixed, widths, k)
                own = path * len(widths) + k + 1
                group = [xxhash.xxh64_intdigest(p.tobytes() + g.tobytes()) for p, g in zip(own, new >> np.uint64(64 - fixed - lead), strict=True)] if fixed + lead > 40 else (own.astype(np.uint64) << np.uint64(40)) | (new >> np.uint64(64 - fixed - lead) if fixed + lead else np.zeros(len(new), np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(group, np.uint64).view(np.int64)), pa.array(own), pa.array(new.view(np.int64)), batch.column(2)], ["g", "path", "v", "fp"])

    return rows.mapInArrow(run, "g long, path long, v long, fp long")


def _indexed(groups: DataFrame, parts: int, fixed: int, widths: list[int], distance: int) -> DataFrame:
    """A spanning forest (a, b of fp) of the links in every group."""

    def forest_of(g: np.ndarray, path: np.ndarray, v: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.concatenate((np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
        a = 0
        out_a, out_b = [], []
        for b in ends:
            if b - a > 1:
                width = widths[(int(path[a]) - 1) % len(widths)]
                exact = ((1 << (fixed + width)) - 1) << (64 - fixed - width)
                index = GrayIndex(v[a:b].view(np.uint64), exact, distance)
                root = index.link()
                member = np.flatnonzero(root != np.arange(b - a))
                own = fp[a:b][index.order]
                out_a.append(own[member])
                out_b.append(own[root[member]])
            a = b
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(cols[0]):
                continue
            held.append(cols)
            size += len(cols[0])
            if size >= GROUP_MEAN and cols[0][-1] != held[0][0][0]:
                g, path, v, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.searchsorted(g, g[-1]))  # the last group may go on
                yield from forest_of(g[:last], path[:last], v[:last], fp[:last])
                held, size = [(g[last:], path[last:], v[last:], fp[last:])], len(g) - last
        if held:
            yield from forest_of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = groups.select("g", "path", "v", "fp").repartition(parts, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a long, b long")


def links(prints: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS, group_mean: int = GROUP_MEAN) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within ``distance``; a staged table in, edges out."""
    n = prints.count()
    rows, fixed, found = prints.select(F.lit(0).cast("long").alias("path"), F.col("fp").alias("v"), "fp"), 0, None
    while True:
        widths = block_widths(64 - fixed, distance + 1)
        width = min(widths)
        lead = min(width, max(0, (n // group_mean).bit_length()))
        groups = staged(_spread(rows, fixed, widths, lead))
        last = 64 - fixed - lead <= group_rows.bit_length() - 1
        hot = None
        if not last:
            hot = groups.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("g")
            hot = staged(hot)
            if not hot.limit(1).count():
                hot = None
        cold = groups if hot is None else groups.join(hot, "g", "left_anti")
        parts = max(1, cut(n * len(widths), 4 * group_mean))
        edges = _indexed(cold, parts, fixed, widths, distance)
        found = edges if found is None else found.union(edges)
        if hot is None:
            return found
        # What one block leaves too large is split by the whole block next.
        rows, fixed = groups.join(hot, "g", "left_semi").select("path", "v", "fp"), fixed + width


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = staged(fingerprints(docs, shingle, seed))
    return linked(prints, links(staged(prints.select("fp").distinct()), distance))


def linked(prints: DataFrame, edges: DataFrame, node: str = "fp") -> DataFrame:
    """Rows of ``prints`` (doc_id, fp) with component_id: the smallest doc_id of their component of ``node`` values."""
    roots = components(edges).toDF("_node", "root")
    first = prints.groupBy(node).agg(F.min("doc_id").alias("first"))
    named = first.join(roots, first[node] == roots["_node"], "left").select(node, "first", F.coalesce("root", node).alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    own = named.join(least, "root").select(node, "component_id")
    return prints.join(own, node).select("doc_id", "fp", "component_id")


def set_links(sets: list[np.ndarray], own: np.ndarray, side: np.ndarray, cross: bool, least: float) -> np.ndarray:
    """For each set its root's position after all pairs of ``least`` similarity are linked.

    Sets of equal ``own`` are linked already. With ``cross`` only pairs from
    side 0 to side 1 are tested. Tiles of sets are multiplied as 0-1 matrices
    over the shingles both tiles have, so every count is exact; tiles that
    differ too much in size or are one component already are passed over.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    forest = Forest(n)
    _, head, at = np.unique(own, return_index=True, return_inverse=True)
    forest.join(head[at], np.arange(n))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes

    def tiles(members: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        members = members[np.argsort(sizes[members], kind="stable")]
        out = []
        for a in range(0, len(members), TILE):
            m = members[a : a + TILE]
            row = np.repeat(np.arange(len(m)), sizes[m])
            col = np.concatenate([ids[begin[k] : begin[k] + sizes[k]] for k in m])
            order = np.argsort(col, kind="stable")
            out.append((m, row[order], col[order], np.unique(col)))
        return out

    def dense(tile: tuple[np.ndarray, ...], columns: np.ndarray) -> np.ndarray:
        m, row, col, _ = tile
        a, b = np.searchsorted(col, columns[0]), np.searchsorted(col, columns[-1], side="right")
        at = np.searchsorted(columns, col[a:b])
        hit = columns[at] == col[a:b]
        out = np.zeros((len(m), len(columns)), np.float32)
        out[row[a:b][hit], at[hit]] = 1
        return out

    left = tiles(np.flatnonzero(side == 0))
    right = tiles(np.flatnonzero(side == 1)) if cross else left
    for i, x in enumerate(left):
        for y in right if cross else right[i:]:
            if sizes[x[0][-1]] < least * sizes[y[0][0]] or sizes[y[0][-1]] < least * sizes[x[0][0]]:
                continue
            root = forest.flatten()
            if (root[x[0]] == root[x[0][0]]).all() and (root[y[0]] == root[x[0][0]]).all():
                continue
            both = np.intersect1d(x[3], y[3], assume_unique=True)
            count = np.zeros((len(x[0]), len(y[0])), np.int64)
            for a in range(0, len(both), COLUMNS):
                columns = both[a : a + COLUMNS]
                count += (dense(x, columns) @ dense(y, columns).T).astype(np.int64)
            p, q = np.nonzero(count >= least * (sizes[x[0]][:, None] + sizes[y[0]][None, :] - count))
            forest.join(x[0][p], y[0][q])
    return forest.flatten()


def _tested(rows: DataFrame, parts: int, least: float) -> DataFrame:
    """Edges (a, b of sid) of a spanning forest of the links in every block of rows."""

    def edges(held: list[tuple]) -> pa.RecordBatch:
        sets = [np.frombuffer(r[5], "<u8") for r in held]
        sid = np.array([r[3] for r in held], np.int64)
        root = set_links(sets, np.array([r[4] for r in held], np.int64), np.array([r[2] for r in held], np.int64), bool(held[0][1]), least)
        member = np.flatnonzero(root != np.arange(len(held)))
        return pa.RecordBatch.from_arrays([pa.array(sid[member]), pa.array(sid[root[member]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield edges(held)
                    held = []
                held.append(row)
        if held:
            yield edges(held)

    dealt = rows.select("block", "cross", "side", "sid", "own", "shingles").repartition(parts, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """sid and the packed distinct shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for begin, end in slices(texts := batch.column(0).to_pylist()):
                packed = [distinct(shingle_hashes(t, shingle, seed)).tobytes() for t in texts[begin:end]]
                sids = np.array([xxhash.xxh64_intdigest(p) for p in packed], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(sids.view(np.int64)), pa.array(packed, pa.binary())], ["sid", "shingles"])

    return docs.select("text").mapInArrow(run, "sid long, shingles binary")


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, least: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id; components hold texts of a shingle-set similarity of ``least`` or more.

    Copies at that similarity differ in more bits than an index of 64 can bear.
    So candidates are groups of two kinds: components of fingerprints linked at
    DISTANCE, and in each of TABLES orders, texts with the same first SAMPLE
    shingles. All pairs of a group are tested on their whole shingle sets, and
    only pairs that pass are edges. A group too large for one task is cut into
    chunks and every two chunks are tested together, so that no pair is left
    out. The groups of FIRST_TABLES orders go first; groups that are one
    component by then, or hold the same texts as another, need no test.
    """
    prints = staged(fingerprints(docs, shingle, seed, TABLES))
    close = components(links(staged(prints.select("fp").distinct()), DISTANCE))
    sampled = prints.select("sid", "size", F.posexplode("samples").alias("t", "key")).where("key <> 0").distinct()
    printed = prints.select("sid", "size", "fp").distinct().join(close, F.col("fp") == F.col("node"), "left")
    keys = sampled.select("t", F.xxhash64("t", "key").alias("g"), "sid", "size")
    keys = keys.union(printed.select(F.lit(-1).alias("t"), F.xxhash64(F.lit(-1), F.coalesce("root", "fp")).alias("g"), "sid", "size"))
    keys = staged(keys.join(keys.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "g", "left_semi"))
    found, roots = None, None
    for lot in (F.col("t") < FIRST_TABLES, F.col("t") >= FIRST_TABLES):
        own = keys.where(lot).select("g", "sid", "size")
        own = own.withColumn("own", F.col("sid")) if roots is None else own.join(roots, F.col("sid") == F.col("node"), "left").select("g", "sid", "size", F.coalesce("root", "sid").alias("own"))
        mark = F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("mark")
        groups = own.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("own").alias("low"), F.max("own").alias("high"), mark).where("low < high")
        groups = groups.groupBy("mark", "n", "total").agg(F.min("g").alias("g"))
        chunks = F.ceil(F.greatest(F.col("n") / TEST_ROWS, F.col("total") / TEST_SHINGLES)).cast("long")
        groups = staged(groups.select("g", chunks.alias("chunks"), (F.col("total") * chunks).alias("sent")))
        sent = groups.agg(F.sum("sent")).first()[0]
        if not sent:
            continue
        members = staged(own.join(groups, "g").select("g", "chunks", "sid", "own"))
        # Texts of candidates alone are read again.
        asked = prints.join(members.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("_id"))
        texts = docs.select("doc_id", "text").join(asked.select("_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        sets = shingle_sets(texts, shingle, seed).groupBy("sid").agg(F.first("shingles").alias("shingles"))
        part = F.pmod(F.xxhash64("sid", F.lit(1)), "chunks")
        sides = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        block = F.xxhash64("g", F.least("part", "other"), F.greatest("part", "other")).alias("block")
        sides = sides.select(block, (F.col("part") != F.col("other")).alias("cross"), (F.col("part") > F.col("other")).cast("int").alias("side"), "sid", "own")
        edges = staged(_tested(sides.join(sets, "sid"), cut(sent, TEST_SHINGLES), least))
        found = edges if found is None else found.union(edges)
        roots = components(found)
    if found is None:
        found = prints.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0)
    return linked(prints, found, "sid")
