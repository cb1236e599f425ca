"""Queries of files, questions and walks against their SQL."""

import duckdb
import pytest

from tracewise.plans import files, queries, questions, walks

NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ in (files.__name__, questions.__name__, walks.__name__) and n in queries.SQL]


@pytest.fixture(scope="module")
def db(sf_dir):
    out = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "part", "events", "documents", "pages", "labels", "conversations"):
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, db, name):
    got = queries.QUERIES[name](spark, sf_dir)
    found = db.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, found.fetchall()))


def test_queries_that_are_compared():
    assert len(NAMES) > 30 and all(queries.QUERIES[n].__module__ != queries.__name__ for n in NAMES)
