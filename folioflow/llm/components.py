"""Connected components of an edge table, without collecting it anywhere.

Edges are first contracted inside each partition (a local union-find that
emits one star per local component), then large-star and small-star rounds
follow: every node points to the smallest node it knows of, first from larger
neighbours, then from smaller ones. Only minima are kept per node, so no group
of neighbours is ever gathered. Each round's edges go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


class Forest:
    """Union-find over numbers 0 to n - 1 that merges arrays of pairs; roots are smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flatten(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self.flatten()
            a, b = self.root[a], self.root[b]
            differ = a != b
            a, b = np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])
            np.minimum.at(self.root, b, a)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs with the same components, a star for each component of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches]
        if not got:
            return
        a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        forest = Forest(len(nodes))
        forest.join(at[: len(a)], at[len(a) :])
        root = forest.flatten()
        other = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    # Now a > b in every row: from each a to its smaller neighbours.
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a")
    return small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b) that isn't the smallest of its component."""
    now = staged(contracted(edges))
    seen = None
    for _ in range(most_rounds):
        got = now.agg(F.count("*").alias("n"), F.count_distinct("a").alias("nodes"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        mark = (got["n"], got["sum"])
        if not got["n"] or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if got["n"] == got["nodes"]:
            # A forest of stars whose centres are no one's members is the end.
            if not now.select(F.col("b").alias("a")).join(now, "a", "left_semi").limit(1).count():
                return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = staged(_stars(now))
    raise RuntimeError("components did not settle")
