"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from vellum.plans import rebuilt, registry, stages

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries() | stages.queries() | rebuilt.queries()
SQL = registry.oracle_sql() | stages.oracle_sql() | rebuilt.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: str(round(v, 6) if isinstance(v, float) else [text(x) for x in v] if isinstance(v, (list, tuple)) else v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
