"""Every query runs; those with SQL give the same rows as DuckDB does."""

import math

import duckdb
import pytest

from anamnesis import source_queries, turn_queries, upkeep_queries  # noqa: F401
from anamnesis.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if not isinstance(v, (int, bool, type(None))) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, cur.fetchall())
