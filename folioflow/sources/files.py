"""Output files and requests as tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import coerce as c

#: Fields of a request, all text as clients send them.
REQUEST = "taskId string, task_id string, fileName string, fileContent string, service string, next_service string, engine string, sourceLang string, targetLang string, threadNum string, qps string, poolSize string, skipLastPages string, mono string, dual string, protocol string"


def write_files(rows: DataFrame, folder: str) -> int:
    """Write rows (name, content) as files of ``folder``, a URI; how many were written.

    The tasks write, each file under a hidden name that is then moved to its
    own, so readers see whole files and a task run again writes the same ones.
    Null names or names with a separator are errors; null content is an empty
    file. Names must be distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"not a file's name: {name!r}")
                hidden = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(content or b"")
                store.move(hidden, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    done = rows.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def output_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size, mtime of a folder's files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ``valid``: whether the bytes look like a whole PDF."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), c.is_pdf(F.col("content")).alias("valid"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests stored as JSON lines, typed by the request rules."""
    return typed_requests(spark.read.schema(REQUEST).json(path))


def typed_requests(raw: DataFrame) -> DataFrame:
    return raw.select(
        c.task_id(F.col("taskId"), F.col("task_id")).alias("task"), F.col("fileName").alias("file_name"), c.decoded_upload(F.col("fileContent")).alias("content"),
        c.engine_service(F.col("engine"), F.col("service"), F.col("next_service")).alias("service"), c.engine_or(F.col("engine"), ("engine-1", "engine-2")).alias("engine"),
        c.text_or(F.col("sourceLang"), 2, "en").alias("source_lang"), c.text_or(F.col("targetLang"), 2, "zh-CN").alias("target_lang"),
        c.at_least_one(F.col("threadNum"), 8).alias("threads"), c.at_least_one(F.col("qps"), 4).alias("qps"), c.pool_size(F.col("poolSize")).alias("pool_size"),
        c.skip_pages(F.col("skipLastPages")).alias("skip_last_pages"), c.request_bool(F.col("mono")).alias("mono"), c.request_bool(F.col("dual")).alias("dual"),
        c.protocol_bool(F.col("protocol")).alias("asynchronous"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of log lines: job (the file's name without its ending), line."""
    lines = spark.readStream.text(folder).withColumn("_file", F.col("_metadata.file_name"))
    return lines.select(F.regexp_replace("_file", r"\.[^.]*$", "").alias("job"), F.col("value").alias("line"))
