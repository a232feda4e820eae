"""The registry, and a few queries against their SQL at the smallest size."""

import os

import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["build_edges", "graph_summary", "top_items", "train_minus_last", "two_stage_topk", "bpr_loss"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert registry.entry(spark).count() == 20


def test_the_grid_trains_by_the_defaults(spark, monkeypatch):
    from graphrec.jobs import queries
    from graphrec.jobs.params import Params

    given = []
    monkeypatch.setattr(queries, "trained_grid", lambda log, p, *rest: given.append((p, *rest)) or spark.range(1).selectExpr("1.0D AS recall", "1.0D AS ndcg", "1.0D AS mrr"))
    queries.QUERIES["grid_search"](spark, "/root/testdata/sf0.001")
    assert given == [(Params(), (32, 64, 128), (2, 3), (1, 2), 10)] and given[0][0].epochs == 20
