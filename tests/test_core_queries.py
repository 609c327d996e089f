"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables; bounded frames where there is no SQL."""

from pathlib import Path

import duckdb
import pytest

from lattica.operators import graph
from lattica.plans import catalogue, graph_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(pdf, names):
    def plain(v):
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in pdf[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, data, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() >= 0


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert Path(__file__).exists()


def test_gap_candidates_see_all_links(spark, data, monkeypatch):
    whole, seen = graph.gaps, []
    monkeypatch.setattr(graph, "gaps", lambda e, c, **more: seen.append((e.count(), c.count())) or whole(e, c, **more))
    assert catalogue.QUERIES["gap_candidates"](spark, data).count() == 10
    n = {t: spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("customer", "part")}
    assert seen == [(graph_queries.links(spark, data).count(), sum(n.values()))]
