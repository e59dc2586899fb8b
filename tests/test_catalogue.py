"""Every query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 8) if isinstance(r[i], float) else r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql_says_the_same(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf), con.execute(catalogue.SQL[name])
    expected = want.fetchall()
    assert expected, "an empty result compares nothing"
    assert rows(got.columns, map(tuple, got.collect())) == rows([c[0] for c in want.description], expected)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.SQL.keys()))
def test_queries_without_sql_run(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["one_hop", "pagerank", "related"])
def test_graph_queries_make_no_pairs(spark, sf, monkeypatch, name):
    def pairs(*_):
        raise AssertionError("pairs of a common name grow with the square of the documents")

    monkeypatch.setattr(catalogue.graph, "build_edges", pairs)
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    assert entry.entry(spark).count() == 10
    assert entry.oracle_sql().keys() <= entry.queries().keys()
