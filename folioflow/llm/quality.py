"""Quality rules: an isolation forest over rule statistics.

Each text gives rule statistics (counts of words, symbols, repeated lines and
words, upper case, punctuation). Documents failing the base rules are rejected.
The others get an anomaly score from an isolation forest: short mean path
lengths over random splits mark rows that few splits separate from the rest.
The threshold, and which statistics
are split on, come from labelled rows.

Training uses at most ``fit_rows`` labelled rows, those with the smallest
hashes of doc_id (two labels of one doc_id are two rows); the statistics and verdicts cover every whole text.

Scale: fitting reads the labelled sample's texts through a broadcast of at most
``fit_rows`` ids; applying is one map over the documents without a shuffle.

Defined results: a null or empty text has zero counts and fails the base rules.
Without labelled rows of both kinds the base rules alone decide. Repeated rows
get equal verdicts. Extra columns are ignored, or kept by ``keep_good``; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow import importable

from .common import SPACES
from .tokens import release

#: Fixed values of the base rules.
MIN_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Labelled rows to learn from, trees, rows a tree, and the share of good rows that must stay.
FIT_ROWS, TREES, TREE_ROWS, GOOD_KEPT = 8192, 100, 256, 0.998
#: Most features that the forest splits on, and trees while they are chosen.
MOST_COLUMNS, CHOOSING_TREES = 4, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    base = len(known)
    if base == n:
        return 0
    key = ids[: n - window + 1].copy()
    size = base
    for k in range(1, window):
        if size * base >= 1 << 62:  # rank again so that the next product fits
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * base + ids[k : n - window + 1 + k]
        size *= base
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts, and the features that the forest splits on."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    duplicates = len(lines) - len({*lines})
    repeated = repeated_words(words)
    marks = sum(text.count(c) for c in ".,;:!?")
    m, c = max(1, n), max(1, chars)
    upper = sum(w.isupper() for w in words) / m
    features = (
        chars / m, symbols / c, duplicates / max(1, len(lines)), repeated / m, upper, marks / m,
        text.count("!") / m, len({*words}) / m ** 0.9, sum(map(text.count, "0123456789")) / c, text.count("|") / m,
    )
    return (n, chars, symbols, duplicates, repeated), features


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MOST_REPEATED_PERCENT * counts[0]


def _average_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random axis-parallel splits, kept as flat arrays."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []  # feature (-1: leaf), split, left child, right child, path length
        todo = [(rows, 0, -1, 0)]
        while todo:
            part, depth, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            low, high = part.min(axis=0), part.max(axis=0)
            free = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) < 2 or not len(free):
                nodes.append([-1, 0.0, 0, 0, depth + float(_average_path(len(part)))])
                continue
            f = int(rng.choice(free))
            at = rng.uniform(low[f], high[f])
            nodes.append([f, at, 0, 0, 0.0])
            left = part[:, f] <= at
            todo += [(part[~left], depth + 1, len(nodes) - 1, 1), (part[left], depth + 1, len(nodes) - 1, 0)]
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; near 1: anomalous."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(rows), int)
            for _ in range(self.depth):
                f = feature[at]
                go = rows[every, np.maximum(f, 0)] <= split[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += path[at]
        return 2 ** (-total / len(self.trees) / max(float(_average_path(self.size)), 1e-9))


@dataclass
class QualityModel:
    """A forest over some of the features and its threshold; without a forest the base rules alone decide."""

    forest: IsolationForest | None
    threshold: float
    columns: tuple[int, ...] = ()

    def scores(self, features: list[tuple[float, ...]]) -> np.ndarray:
        return self.forest.score(np.array(features)[:, self.columns]) if self.forest and features else np.zeros(len(features))


def calibrate(scores: np.ndarray, good: np.ndarray, kept: float = GOOD_KEPT) -> float:
    """The threshold with fewest errors among those that keep a share ``kept`` of good rows."""
    least = np.quantile(scores[good], kept, method="higher")
    bad = np.sort(scores[~good])
    options = np.unique(np.concatenate(([scores[good].max()], scores[good][scores[good] >= least])))
    errors = [(scores[good] > t).sum() + np.searchsorted(bad, t, side="right") for t in options]
    t = options[::-1][int(np.argmin(errors[::-1]))]
    above = bad[bad > t]
    return float((t + above[0]) / 2) if len(above) else float(t)


def chosen_columns(x: np.ndarray, good: np.ndarray) -> tuple[int, ...]:
    """Features on which a forest makes fewest errors, added one by one.

    Splits on features in which good rows differ widely hide what sets bad rows
    apart, so only features that help on labelled rows are split on.
    """
    best: tuple[int, ...] = ()
    least = int((~good).sum()) + 1
    while len(best) < MOST_COLUMNS:
        found = None
        for f in range(x.shape[1]):
            if f not in best and np.ptp(x[:, f]) > 0:
                part = x[:, (*best, f)]
                scores = IsolationForest(part, CHOOSING_TREES).score(part)
                t = calibrate(scores, good)
                errors = int((scores[good] > t).sum() + (scores[~good] <= t).sum())
                if errors < least:
                    least, found = errors, f
        if found is None:
            return best
        best = (*best, found)
    return best


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from at most ``fit_rows`` labelled rows; the forest sees good and bad ones alike."""
    importable(docs.sparkSession)
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)  # at most fit_rows narrow rows: safe to broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    names = [f"f{i}" for i in range(len(statistics("")[1]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            got = [(q, statistics(t)) for q, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            got = [(q, f) for q, (c, f) in got if not base_failed(c)]
            cols = [pa.array([q for q, _ in got], pa.int32()), *(pa.array([f[i] for _, f in got], pa.float64()) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays(cols, ["quality", *names])

    rows = sample.withColumn("quality", F.col("quality").cast("int")).mapInArrow(run, "quality int, " + ", ".join(f"{n} double" for n in names))
    # Ids that several documents share could give more rows than labels; then those with the smallest hashes stay.
    rows = rows.orderBy(F.xxhash64("quality", *names), "quality", *names).limit(fit_rows).toPandas().sort_values(["quality", *names])
    x, good = rows[names].to_numpy(), rows["quality"].to_numpy() == 1
    if len(x) < 16 or good.all() or not good.any():
        return QualityModel(None, 1.0)
    columns = chosen_columns(x, good)
    if not columns:
        return QualityModel(None, 1.0)
    forest = IsolationForest(x[:, columns])
    return QualityModel(forest, calibrate(forest.score(x[:, columns]), good), columns)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the anomaly score of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            got = [statistics(t) for t in batch.column(1).to_pylist()]
            failed = np.array([base_failed(c) for c, _ in got], bool)
            scores = shared.value.scores([f for _, f in got])
            kept = ~failed & (scores <= shared.value.threshold)
            cols = [batch.column(0), *(pa.array([c[i] for c, _ in got], pa.int64()) for i in range(len(COUNTS))), pa.array(failed), pa.array(kept), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            got = [statistics(t) for t in batch.column(at).to_pylist()]
            scores = shared.value.scores([f for _, f in got])
            kept = [not base_failed(c) and s <= shared.value.threshold for (c, _), s in zip(got, scores, strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
