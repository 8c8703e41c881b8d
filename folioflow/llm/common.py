"""Shared helpers: inputs, the shared folder, staged tables, folds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import importable

#: A word, as every contract of this subpackage defines it.
WORD = r"[^\x20\x09-\x0D]+"

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset,
    in local mode (tests) a temporary folder of this machine is used; a cluster
    must name one, as its machines can't read each other's disks.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    This cuts the lineage: lost executors re-read files instead of running
    tokenizers or hashes again, and several later passes share one result.
    """
    spark = importable(df.sparkSession)
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text modulo ``buckets``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % buckets


def cut(total: int, size: int) -> int:
    """How many blocks of about ``size`` hold ``total``; one at least."""
    return max(1, -(-int(total) // size))


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Mark a stored table for broadcast if it has at most ``most`` rows; a larger one is joined as it is."""
    return F.broadcast(df) if df.count() <= most else df
