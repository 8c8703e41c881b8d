"""A8: configuration, output files and logs written to the shared folder and read back; preferences read from a column."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources import config, files

from .base import literal, query
from .streams import finished, shared_root


def _folder(df: DataFrame, kind: str) -> str:
    return f"{shared_root(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"


#: One configuration a supplier, with nested keys, numbers, flags, lists and null.
_CONFIG = " UNION ALL ".join(
    f"SELECT concat('s', CAST(s_suppkey AS STRING)) AS name, '{path}' AS path, {value} AS value FROM {{supplier}}"
    for path, value in [
        ("name", f"concat({literal(chr(34))}, s_name, {literal(chr(34))})"), ("limits/nation", "CAST(s_nationkey AS STRING)"), ("limits/even", "CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END"),
        ("limits/none", "'null'"), ("keys", "concat('[', CAST(s_suppkey AS STRING), ', true]')"),
    ]
)


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("name").alias("file"), F.split("path", "/").alias("path"), "value")


def _read_back(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract("file", "file=([^/]*)", 1).alias("name"), F.array_join("path", "/").alias("path"), "value")


@query("a8_03_05_json_configuration", _CONFIG, "SELECT name, path, value FROM src")
def json_configuration(df: DataFrame) -> DataFrame:
    """A version with half of the values, replaced by the whole one; readers take the newest."""
    folder = _folder(df, "json")
    config.write_json_config(_rows(df).where(F.size("path") == 1), folder)
    config.write_json_config(_rows(df), folder)
    return _read_back(config.read_json_config(df.sparkSession, config.newest_version(df.sparkSession, folder)))


@query("a8_04_toml_configuration", _CONFIG, f"SELECT name, path, CASE value WHEN 'null' THEN {literal(chr(34) + 'null' + chr(34))} ELSE value END AS value FROM src")
def toml_configuration(df: DataFrame) -> DataFrame:
    folder = _folder(df, "toml")
    config.write_toml_config(_rows(df), folder)
    return _read_back(config.read_toml_config(df.sparkSession, config.newest_version(df.sparkSession, folder)))


_FILES = "SELECT concat('s', CAST(s_suppkey AS STRING), '.pdf') AS name, concat(CASE WHEN s_suppkey % 3 > 0 THEN '%PDF-1.7 ' ELSE '' END, s_name, CASE WHEN s_suppkey % 4 > 0 THEN ' %%EOF' ELSE '' END) AS content FROM {supplier}"


@query("a8_02_output_files", _FILES, "SELECT name, length(content) AS size, contains(content, '%PDF') AND contains(content, '%%EOF') AS valid FROM src")
def output_files(df: DataFrame) -> DataFrame:
    folder = _folder(df, "files")
    files.write_files(df, folder)
    listed, judged = files.output_files(df.sparkSession, folder), files.pdf_files(df.sparkSession, folder)
    return listed.join(judged.select("path", "valid"), "path").select("name", "size", "valid")


def _entry(key: str) -> str:
    return " || ".join([literal('[{"key":"'), key, literal('","service":"s","activate":true},{"service":"t"},{"key":"'), f"CAST({key} AS STRING)", literal('x","service":"t","model":"m"}]')])


_STORED = f"SELECT c_custkey AS id, {_entry('CAST(c_custkey AS STRING)')} AS value FROM {{customer}}"


@query("a8_06_preferences", _STORED, "SELECT id, CAST(id AS STRING) AS key, 's' AS service, CAST(NULL AS STRING) AS model, true AS activate FROM src UNION ALL SELECT id, CAST(id AS STRING) || 'x', 't', 'm', false FROM src")
def preferences(df: DataFrame) -> DataFrame:
    return config.preferences(df).select("id", "key", "service", "model", "activate")


_LOGS = "SELECT concat('job', CAST(s_suppkey AS STRING), '.log') AS name, concat(s_name, chr(10), 'translate ', CAST(s_nationkey AS STRING), '/25', chr(10)) AS content FROM {supplier}"


@query("a8_08_log_lines", _LOGS, "SELECT string_split(name, '.')[1] AS job, unnest(string_split(rtrim(content, chr(10)), chr(10))) AS line FROM src")
def log_lines(df: DataFrame) -> DataFrame:
    """Lines that a stream reads from log files, each batch in a folder of its own that a second run replaces."""
    logs, told = _folder(df, "logs"), _folder(df, "lines")
    files.write_files(df, logs)
    lines = files.log_lines(df.sparkSession, logs).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{told}/state")
    query = lines.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{told}/lines/batch={k}")).start()
    finished(query)
    return df.sparkSession.read.parquet(f"{told}/lines").select("job", "line")
