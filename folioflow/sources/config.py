"""Configuration files as rows of (file, path, value), and back.

``value`` is JSON text, so that numbers, flags, texts and null stay apart;
``path`` is an array of keys. Files are read by Spark (``binaryFile``), so any
store that Spark knows will do; parsing runs next to the data.
"""

from __future__ import annotations

import json
import re
import time
import tomllib
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "file string, path array<string>, value string"


def flattened(value: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """Leaves of nested maps; lists and empty maps are leaves."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flattened(v, (*path, str(k)))
    else:
        yield path, json.dumps(value, ensure_ascii=False, default=str)


def _read(spark: SparkSession, path: str, parse: Callable[[str], Any]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(file, list(at), v) for file, content in zip(frame["path"], frame["content"], strict=True) for at, v in flattened(parse(bytes(content).decode()))]
            yield pd.DataFrame(rows, columns=["file", "path", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _ROWS)


def read_json_config(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, json.loads)


def read_toml_config(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, tomllib.loads)


def nested(rows: list[tuple[list[str], str]]) -> Any:
    """Rows of one file back as nested maps."""
    out: dict = {}
    for path, value in rows:
        at = out
        for k in path[:-1]:
            at = at.setdefault(k, {})
        if path:
            at[path[-1]] = json.loads(value)
    return out


def toml_text(config: dict, head: tuple[str, ...] = ()) -> str:
    """Nested maps as TOML: values of a table first, then its tables. Null has no form there and is written as "null"."""
    plain = {k: v for k, v in config.items() if not (isinstance(v, dict) and v)}
    name = lambda k: k if re.fullmatch("[A-Za-z0-9_-]+", k) else json.dumps(k)

    def form(v: Any) -> str:
        if isinstance(v, list):
            return f"[{', '.join(map(form, v))}]"
        if isinstance(v, dict):
            return f"{{{', '.join(f'{name(k)} = {form(x)}' for k, x in v.items())}}}"
        return json.dumps("null" if v is None else v)

    lines = [f"[{'.'.join(map(name, head))}]"] if head and (plain or not config) else []
    lines += [f"{name(k)} = {form(v)}" for k, v in plain.items()]
    return "\n".join([*lines, *(toml_text(v, (*head, k)) for k, v in config.items() if k not in plain)])


def _write(rows: DataFrame, path: str, form: Callable[[dict], str]) -> str:
    """One text file per configuration in a new version below ``path``; its name, after which readers see it."""
    version = f"version={time.time_ns()}"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        config = nested(sorted(([*p], v) for p, v in zip(frame["path"], frame["value"], strict=True)))
        return pd.DataFrame({"value": [form(config)], "file": [quote(frame["file"].iloc[0].rsplit("/", 1)[-1], safe="")]})

    rows.groupBy("file").applyInPandas(run, "value string, file string").write.partitionBy("file").text(f"{path.rstrip('/')}/{version}")
    return version


def write_json_config(rows: DataFrame, path: str) -> str:
    """JSON text of every configuration, in a new version of the folder ``path``.

    Spark's commit marks a version as whole, and readers take the newest whole
    one (``newest_version``), so they see the old files or the new ones.
    """
    return _write(rows, path, lambda c: json.dumps(c, ensure_ascii=False))


def write_toml_config(rows: DataFrame, path: str) -> str:
    """The same as TOML."""
    return _write(rows, path, toml_text)


def newest_version(spark: SparkSession, path: str) -> str:
    """Pattern of the files of the newest version that was written whole."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = store.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS"))
    names = [d.getPath().getParent().getName() for d in done]
    if not names:
        raise FileNotFoundError(path)
    return f"{path.rstrip('/')}/{max(names, key=lambda n: int(n.partition('=')[2]))}/*/*.txt"


def preferences(rows: DataFrame, column: str = "value") -> DataFrame:
    """Provider entries of stored JSON lists, one row each."""
    from folioflow.operators.keyed import loaded

    return rows.select(*[c for c in rows.columns if c != column], F.explode(loaded(F.col(column))).alias("_e")).select("*", "_e.*").drop("_e")
