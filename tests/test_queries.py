"""Every survey query that has SQL gives its rows."""

import pytest

from quadrat import queries, queries_more  # noqa: F401


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = sorted(repr(r) for r in duck.execute(f"SELECT {cols} FROM ({queries.SQL[name]})").fetchall())
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_works_without_the_operators(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_found", lambda name: None)
    assert set(entry.queries()) == set(queries.QUERIES)
    assert set(entry.oracle_sql()) == set(queries.SQL)
