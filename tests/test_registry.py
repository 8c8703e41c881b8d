"""Every query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from folioflow.plans.registry import ORACLE_SQL, QUERIES

from .conftest import SMALL


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return sorted((k, plain(v)) for k, v in value.items())
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    got = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    keys = sorted(columns)
    ours = sorted(repr([plain(r[k]) for k in keys]) for r in df.collect())
    theirs = sorted(repr([plain(r[columns.index(k)]) for k in keys]) for r in got.fetchall())
    assert ours == theirs


def test_notices_of_a_larger_table(spark, tmp_path):
    """45,000 notices, of which 22,500 are for all versions: every one of them meets the versions."""
    spark.range(45_000).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(9).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    QUERIES["a3_04_notices"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con.execute(f"CREATE TABLE want AS {ORACLE_SQL['a3_04_notices']}")
    con.execute(f"CREATE TABLE got AS SELECT id, version FROM '{tmp_path}/out/*.parquet'")
    assert con.execute("SELECT count(*) FROM want").fetchone()[0] > 50_000
    assert con.execute("SELECT (SELECT count(*) FROM (FROM want EXCEPT ALL FROM got)), (SELECT count(*) FROM (FROM got EXCEPT ALL FROM want))").fetchone() == (0, 0)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() and set(df.columns) == {"job", "progress", "message", "status", "ended", "seq"}
