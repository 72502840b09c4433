"""Expressions whose values change places, and how they round."""

from pyspark.sql import functions as F

from quadrat.functions.expr import col, compute
from quadrat.sample import Sample


def test_positions_count_within_groups(spark):
    """Groups of 40 rows, dealt over partitions in turns; nulls and equal values among them."""
    df = spark.range(0, 240, 1, 4).select("id", (F.col("id") % 6).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 37 % 23).alias("v"))
    v, by = col("v"), lambda e: e.over("g")
    specs = {
        "up": by(v.sort()), "down": by(v.sort(descending=True, nulls_last=True)), "at": by(v.arg_sort()), "at_down": by(v.arg_sort(descending=True, nulls_last=True)),
        "turned": by(v.reverse()), "sorted_turned": by(v.sort().reverse()), "twice": by((v * 2).sort()) + 1, "dealt": by(v.shuffle(3)), "whole": v.sort(), "total": v.sum(),
    }
    out = Sample(df).wrangling.mutate(specs).data
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(out.collect())
    assert [r["id"] for r in rows] == list(range(240))
    assert [r["whole"] for r in rows] == sorted([r["v"] for r in rows], key=lambda x: (x is not None, x or 0))
    assert {r["total"] for r in rows} == {sum(r["v"] or 0 for r in rows)}
    for g in range(6):
        group = [r for r in rows if r["g"] == g]
        got = {k: [r[k] for r in group] for k in specs}
        x = [r["v"] for r in group]
        at = sorted(range(40), key=lambda i: (x[i] is not None, x[i] or 0))
        down = sorted(range(40), key=lambda i: (x[i] is None, -(x[i] or 0)))
        up = [x[i] for i in at]
        assert (got["at"], got["at_down"], got["up"], got["down"]) == (at, down, up, [x[i] for i in down])
        assert (got["turned"], got["sorted_turned"], got["twice"]) == (x[::-1], up[::-1], [None if i is None else 2 * i + 1 for i in up])
        assert got["dealt"] != x and sorted(map(str, got["dealt"])) == sorted(map(str, x))


def test_specs_see_each_other_through_moved_values(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "g int, x int").coalesce(1)
    out = Sample(df).wrangling.mutate({"low": col("z").sort().over("g"), "z": col("x") * 10, "mean": col("z").mean()}).data
    assert sorted(map(tuple, out.select("g", "x", "low", "z", "mean").collect())) == [(1, 3, 50, 30, 40.0), (1, 5, 30, 50, 40.0), (2, 4, 40, 40, 40.0)]


def test_round_is_that_of_sql(spark):
    """Quotients near the middle of two results, where decimal digits and the float product disagree."""
    import duckdb

    values = [a / b - 1 for b in (5.12, 10.24, 51.2, 102.4) for a in (k / 100 for k in range(1, 6000, 7))] + [2.675, 1.005, -0.285, 1e300, 0.49999999999999994, float("inf"), None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double").coalesce(1)
    out = compute(df, {"nine": col("x").round(9), "two": col("x").round(2), "zero": col("x").round(), "tens": (col("x") * 1000).round(-1), "whole": col("id").round(1)})
    assert dict(out.dtypes)["whole"] == "int"
    got = sorted(map(tuple, out.select("id", "nine", "two", "zero", "tens", "whole").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = con.execute("SELECT id, round(x, 9), round(x, 2), round(x, 0), round(x * 1000, -1), id FROM t ORDER BY id").fetchall()
    assert [(a, b) for a, b in zip(got, want) if a != b] == []
