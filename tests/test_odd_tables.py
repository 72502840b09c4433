"""Queries on tables that the driver's small ones are not like, against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrat import queries, queries_more  # noqa: F401
from quadrat.design import Design, PopSize
from quadrat.sample import Sample


def both(spark, path, name, **tables):
    """Rows of a query and of its SQL over ``tables``, frames that are written first."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(path))
    cols = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(repr(tuple(r)) for r in df.collect()), sorted(repr(r) for r in con.execute(f"SELECT {cols} FROM ({queries.SQL[name]})").fetchall())


def test_mean_fpc_with_more_suppliers_than_the_population(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_suppkey", F.col("l_orderkey"))
    got, want = both(spark, tmp_path, "mean_fpc", lineitem=lines)
    assert got == want and "nan" in got[0]


@pytest.mark.parametrize("n", [4, 3, 2])
def test_population_below_the_sample_has_no_standard_error(spark, n):
    """Three units of one row: the variance of the mean is (1 - 3 / N) * 1.25 ** 2 / 3."""
    df = spark.createDataFrame([(k, k * 1.25, n) for k in range(3)], "psu int, y double, pop int")
    s = Sample(df, Design(psu="psu", pop_size=PopSize("pop")))
    row = s.estimation.mean("y").rows()[0]
    expected = math.sqrt((1 - 3 / n) / 3) * 1.25 if n >= 3 else math.nan
    assert row["est"] == 1.25
    assert row["se"] == pytest.approx(expected, nan_ok=True)
    assert math.isnan(row["lci"]) == (n < 3)


def test_running_changes_at_ties(spark, tmp_path):
    """Quotients by 51.2 and 102.4 end at the tenth digit with a 5."""
    pairs = [(38.03, 51.2), (49.82, 102.4), (49.42, 102.4), (3.01, 10.24), (0.0, 10.24), (5.0, 0.0)]
    rows = [(2 * k + j, k, "view", x) for k, (v, before) in enumerate(pairs) for j, x in enumerate((before, v))]
    got, want = both(spark, tmp_path, "expr_running", events=spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double"))
    assert got == want
