"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target in words: a share of ``total_share`` times all
words by weight, at most ``most_copies`` times the source's own words, with the
excess reshared by weight among the others. All sources that stay below their
limit then have targets in proportion to weight, so the common factor is found
from running sums over sources sorted by limit / weight.

A source takes as many whole copies of every document as its target holds for
certain. The rest is a fixed-size sample: each document has a uniform number u
from its id, an inclusion probability p, and the rank
(u / (1 - u)) / (p / (1 - p)); documents with the smallest ranks are taken
until the words reach what is left of the target. By default p is the same
throughout a source; a ``weight_col`` makes it unequal inside it too, in
proportion to the weight and at most ``most_p``.

Scale: documents are read once and staged as narrow rows. No window runs over
all rows of a source: ranks are dealt into buckets of p-adjusted order, about
``bucket_rows`` of all rows each, words are summed per (source, bucket), and
only the one bucket per source in which the target is reached gets ordered row
by row. Windows over sources have one row per source. Targets and edges, a row
per source each, are broadcast if their rows are counted to be few, and joined
like any table otherwise.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; rows of size 0 take 0 words. Repeated rows are drawn like
others; ties in rank are cut in the order of doc_id, then size. A row with a
null doc_id is drawn by its text. Reruns agree.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small_side, staged

#: Weights of sources in code-point order, repeating; share of all words; most copies of a document.
WEIGHTS, TOTAL_SHARE, MOST_COPIES = (5, 2, 1), (3, 2), 2
LEAST_BUCKETS, BUCKET_ROWS, MOST_P, SEED = 4096, 8192, 0.999, "mix-1"
_SPACE = 1 << 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(name: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from a name; null counts as empty text."""
    text = F.concat(F.coalesce(name.cast("string"), F.lit("")), F.lit(f"/{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(_SPACE))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows of (source, size). One row per source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_w", weight.cast("long"))
    # Limits met first: those with the smallest size per weight.
    by_limit = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    met = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    num, den = share
    free = F.lit(num) * F.sum("source_size").over(whole) - F.lit(den * most) * F.coalesce(F.sum("source_size").over(met), F.lit(0))
    open_w = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(met), F.lit(0))
    sources = sources.withColumn("_factor", free / (F.lit(den) * open_w))
    # The first source in this order whose share is not above its limit fixes the factor of all later ones.
    fits = F.col("_factor") * F.col("_w") <= F.lit(most) * F.col("source_size")
    factor = F.min(F.when(fits, F.struct(F.col("source_size") / F.col("_w"), F.col("_factor").alias("f")))).over(whole).getField("f")
    target = F.least(F.lit(most) * F.col("source_size").cast("double"), F.coalesce(factor * F.col("_w"), F.lit(most) * F.col("source_size").cast("double")))
    return sources.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = TOTAL_SHARE, most: int = MOST_COPIES, seed: str = SEED, weight_col: str | None = None, name_col: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``.

    A row is drawn by its ``name_col``, by default its doc_id, or its text where that is null.
    """
    name = F.col(name_col) if name_col else F.coalesce(F.col("doc_id").cast("string"), "text")
    lean = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(name, seed).alias("_u"), *([F.col(weight_col).cast("double").alias("weight")] if weight_col else []))
    sized = staged(lean)
    buckets = max(LEAST_BUCKETS, cut(sized.count(), bucket_rows))
    targets = source_targets(sized, weights, share, most)
    if weight_col:
        per = sized.groupBy("source").agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("size")).alias("_mass"))
        targets = targets.withColumnRenamed("source", "_s").join(per, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    certain = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("long")
    targets = targets.withColumn("_certain", certain).withColumn("_rest", F.col("target") - certain * F.col("source_size"))
    p = F.col("_rest") / F.col("source_size")
    if weight_col:
        p = F.when(F.col("_mass") > 0, F.col("_rest") * F.coalesce("weight", F.lit(0.0)) / F.col("_mass")).otherwise(p)
    targets = targets.withColumnRenamed("source", "_source")
    # Rows of a hot source must not meet in one task, so the sources go to the rows.
    rows = sized.join(small_side(staged(targets)), sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_p", F.least(F.greatest(p, F.lit(1e-12)), F.lit(MOST_P)))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    # rank / (1 + rank) is in (0, 1) and in the same order; equal p throughout a source spread it unevenly, u doesn't.
    rows = rows.withColumn("_rank", odds)
    even = F.col("_u") if not weight_col else F.col("_rank") / (1 + F.col("_rank"))
    rows = rows.withColumn("_bucket", F.floor(even * buckets).cast("long"))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_in"), F.first("_rest").alias("_rest"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    edge = sums.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_in") >= F.col("_rest")))
    edge = edge.select(F.col("source").alias("_source"), F.col("_bucket").alias("_edge"), "_before")
    rows = rows.join(small_side(staged(edge)), rows["source"].eqNullSafe(F.col("_source")), "left").drop("_source")
    in_edge = F.col("_bucket") == F.col("_edge")
    ordered = Window.partitionBy("source").orderBy("_rank", "doc_id", "size")
    running = F.col("_before") + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # The last document is taken if that ends nearer to the target than stopping before it.
    taken_edge = F.when(running - F.col("size") + running <= 2 * F.col("_rest"), 1).otherwise(0)
    edge_rows = rows.where(in_edge).withColumn("_extra", taken_edge)
    rest = rows.where(~F.coalesce(in_edge, F.lit(False))).withColumn("_extra", F.when((F.col("_bucket") < F.col("_edge")) | (F.col("_edge").isNull() & (F.col("_rest") > 0)), 1).otherwise(0))
    done = rest.unionByName(edge_rows).withColumn("copies", F.col("_certain") + F.col("_extra"))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
