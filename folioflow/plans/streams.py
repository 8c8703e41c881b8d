"""A4.11 to A4.13: job state kept by a stream, compared with the batch fold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow import importable
from folioflow.streaming.jobs import snapshots

from . import progress
from .base import ORACLE_SQL, QUERIES

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; in local mode, if none is named, one of this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
    return root.rstrip("/")


def finished(query: StreamingQuery, seconds: int = 600) -> None:
    """Wait for a stream that ends by itself; one that doesn't is stopped and is an error, as its rows would be a part."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end within {seconds} seconds")


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshot per job after a stream has read all events, file by file."""
    importable(spark)
    events = spark.readStream.schema(_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events.createOrReplaceTempView(view := f"events_{uuid.uuid4().hex}")
    lines = spark.sql(progress._LINES.replace("{events}", view))
    path = f"{shared_root(spark)}/jobs-{uuid.uuid4().hex}"
    snapped = snapshots(progress.updates(lines), evict=False).writeStream.outputMode("update").trigger(availableNow=True)
    query = snapped.option("checkpointLocation", f"{path}/state").foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/told/batch={k}")).start()
    finished(query)
    spark.catalog.dropTempView(view)
    told = spark.read.parquet(f"{path}/told")
    return told.groupBy("job").agg(F.max_by(F.struct("progress", "message", "status", "seq"), "seq").alias("s")).select(F.col("job").cast("long").alias("job"), "s.*")


_BATCH = progress._FOLD + """
SELECT l.job, CASE WHEN d.ok THEN 100 ELSE coalesce(l.progress, 0) END AS progress, l.message, CASE WHEN d.ok THEN 'done' WHEN NOT d.ok THEN 'failed' ELSE 'running' END AS status, l.seq
FROM l LEFT JOIN (SELECT job, arg_max(ok, seq) AS ok FROM c GROUP BY job) d ON l.job = d.job"""

QUERIES["a4_11_13_stream_jobs"] = stream_jobs
ORACLE_SQL["a4_11_13_stream_jobs"] = f"WITH src AS ({progress._LINES.replace('{events}', 'events')}), {_BATCH.lstrip().removeprefix('+')}"

