"""Every query of the engine that has SQL agrees with DuckDB on the smallest tables."""

import os

import pytest

from hanmoa.plans import golden, ranked, registry

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"
QUERIES = registry.QUERIES | golden.QUERIES | ranked.QUERIES
ORACLES = registry.ORACLES | golden.ORACLES | ranked.ORACLES


@pytest.fixture(scope="module")
def views():
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    c = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == len(registry.QUERIES) + len(golden.QUERIES) + len(ranked.QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, views, name):
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    found = views.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expect = sorted((tuple(row[names.index(c)] for c in columns) for row in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expect
