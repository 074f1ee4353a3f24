"""The registered queries: SQL where there is some, the contracts' columns, and the pipeline's effects."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anamnesis.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(str(r) for r in cur.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns, name
        if name != "mixing":
            assert 0.4 * docs.count() < out.count() <= docs.count()
        docs = out
    index = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert index.agg(F.max("slot") + 1, F.count("*")).collect()[0][0] == index.count()
