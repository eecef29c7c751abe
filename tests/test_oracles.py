"""Every query against its SQL on the same tables: columns, types and rows."""

import glob
import math
import os

import duckdb
import pytest

from framelake.registry import ORACLE_SQL, QUERIES

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, db, name):
    df, sql = QUERIES[name](spark, sf), db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == {c: TYPES.get(str(t), str(t)) for c, t in sorted(zip(sql.columns, sql.types))}
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(map(plain, r)) for r in db.sql(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
