"""The registered queries: those with SQL against DuckDB, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from lattica.llm import queries

TABLES = "documents conversations benchmark labels".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, data, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data).toPandas()
    want = c.sql(queries.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    one = lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)  # noqa: E731  # a column of whole numbers with nulls
    plain = lambda df: sorted(tuple(map(one, r)) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False))
    assert plain(got) == plain(want)


def test_all_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))


def test_pipeline(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and len(now) == docs.count()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
        before = now
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).select("doc_id").collect()} == before
