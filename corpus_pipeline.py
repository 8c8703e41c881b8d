"""Corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it for the next stage.
All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import mixing, packing, quality, simhash, substring
from folioflow.llm.common import documents, staged

#: Words in a passage that substring dedup removes; anchors within it.
PASSAGE, PASSAGE_ANCHOR = 50, 8
_ROW, _COPY = "__folio_row", "__folio_copies"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep.

    Nulls and empty texts are rejected; repeated rows get the same verdict.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, then the first row.

    Rows are told apart by a number, which is stored with them, as another scan
    of the input may number them otherwise. So repeated rows and null ids are
    handled like any other; all empty texts are one group.
    """
    rows = staged(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    found = staged(simhash.near_copies(rows.select(F.col(_ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(_ROW), "component_id"))
    first = rows.select(_ROW, "doc_id").join(found, _ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _ROW)).alias("m"))
    return rows.join(first.select(F.col(f"m.{_ROW}").alias(_ROW)), _ROW, "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE words that a document with a smaller doc_id has.

    White space between kept words stays; a document without a kept word goes.
    """
    return substring.strip_repeats(docs, PASSAGE, PASSAGE_ANCHOR)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of every document as the mix takes; none drops it.

    A text of no words counts no words and stays out where its copies are none.
    Rows are drawn by id and text, so reruns agree; a stored number tells
    repeated rows apart.
    """
    rows = staged(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    name = F.concat_ws("/", "doc_id", F.xxhash64("text").cast("string")).alias("_name")
    taken = mixing.mix(rows.select(F.col(_ROW).alias("doc_id"), "source", "text", name), name_col="_name")
    taken = taken.select(F.col("doc_id").alias(_ROW), F.col("copies").alias(_COPY))
    rows = rows.join(taken.where(F.col(_COPY) > 0), _ROW)
    return rows.withColumn(_COPY, F.explode(F.sequence(F.lit(1).cast("long"), F.col(_COPY)))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in token sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing to target weights", mixing_to_weights),
    ("best-fit packing", best_fit_packing),
]

#: The isolation forest, the index and the tokenizer can't be put in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
