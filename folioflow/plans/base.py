"""Queries in two forms: a Spark plan and the SQL that must give the same rows.

Inputs that no table holds are derived from the driver's tables by SQL that
Spark and DuckDB read alike (integer arithmetic on keys, no escapes), so both
forms start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def pick(key: str, values: list[str | None]) -> str:
    """SQL that picks one of ``values`` by ``key`` modulo their number; doubled quotes and chr() for the rest."""
    cases = " ".join(f"WHEN {k} THEN {literal(v)}" for k, v in enumerate(values))
    return f"(CASE CAST(({key}) % {len(values)} AS INT) {cases} END)"


def literal(value: str | None) -> str:
    """A string both engines read alike: quotes, backslashes and controls by their code points."""
    if value is None:
        return "CAST(NULL AS STRING)"
    odd = r"[{}'\\\x00-\x1f\x7f]"
    parts = [p for p in re.split(f"({odd})", value) if p]
    if not parts:
        return "''"
    return "(" + " || ".join(f"chr({ord(p)})" if re.fullmatch(odd, p) else f"'{p}'" for p in parts) + ")"


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run input SQL; ``{name}`` stands for a table."""
    names = {*re.findall(r"\{(\w+)\}", sql)}
    importable(spark)
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def query(name: str, source: str, sql: str, **more: str) -> Callable:
    """Register ``plan(df)`` under ``name``: ``df`` comes from ``source``, and ``sql`` reads it as ``src``.

    ``more`` holds further inputs, passed to the plan by name and to SQL as tables.
    """
    inputs = {"src": source} | more

    def register(plan: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = {k: derived(spark, sf_dir, v) for k, v in inputs.items()}
            return plan(frames.pop("src"), **frames)

        QUERIES[name] = run
        plain = [f"{k} AS ({re.sub(r'[{](\w+)[}]', r'\1', v)})" for k, v in inputs.items()]
        ORACLE_SQL[name] = f"WITH {', '.join(plain)}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return plan

    return register
