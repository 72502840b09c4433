"""Driver queries of the survey operators, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.design import Design, PopSize
from quadrat.functions.expr import coalesce, col, concat_str, lit, max_horizontal, sum_horizontal, when
from quadrat.functions.terms import Cat
from quadrat.sample import Sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, **more) -> Sample:
    """Order lines: strata by return flag, clusters by supplier, quantity as weight."""
    df = read(spark, sf_dir, "lineitem")
    return Sample(df, Design(stratum="l_returnflag", psu="l_suppkey", wgt="l_quantity", **more))


def customers(spark: SparkSession, sf_dir: str) -> Sample:
    df = read(spark, sf_dir, "customer").withColumn("w", F.abs("c_acctbal") + 1)
    return Sample(df, Design(stratum="c_mktsegment", psu="c_nationkey", wgt="w"))


def half(spark: SparkSession, sf_dir: str) -> Sample:
    """Orders: strata by priority, two PSUs in each."""
    df = read(spark, sf_dir, "orders").withColumns({"psu": (F.col("o_orderkey") % 2).cast("int"), "one": F.lit(1.0)})
    return Sample(df, Design(stratum="o_orderpriority", psu="psu", wgt="one"))


def rounded(df: DataFrame, keep: list[str], **digits: int) -> DataFrame:
    return df.select(*keep, *[F.round(c, n).alias(c) for c, n in digits.items()])


def linear_sql(source: str, y: str, x: str, ok: str = "TRUE", by: str = "", kind: str = "mean", w: str = "l_quantity", strata: str = "l_returnflag", psu: str = "l_suppkey", fpc: str = "1.0", digits: tuple[int, int] = (4, 4), more: str = "") -> str:
    """Linearized estimate of sum(wy) / sum(wx) (or sum(wy)) in SQL: every design PSU stays, zeros outside the domain."""
    keys = f"{by}, " if by else ""
    on = f"u.{by} = t.{by}" if by else "TRUE"
    z = "uy" if kind == "total" else "(uy - ty / tx * ux) / tx"
    est = "ty" if kind == "total" else "ty / tx"
    return f"""
WITH u AS (SELECT {keys}{strata} AS h, {psu} AS p, sum(CASE WHEN {ok} THEN {w} * ({y}) ELSE 0 END) AS uy,
                  sum(CASE WHEN {ok} THEN {w} * ({x}) ELSE 0 END) AS ux, sum(CASE WHEN {ok} AND {w} > 0 THEN 1 ELSE 0 END) AS un
           FROM {source} GROUP BY ALL),
m AS (SELECT h, count(DISTINCT p) AS m FROM u GROUP BY h),
t AS (SELECT {keys}sum(uy) AS ty, sum(ux) AS tx, sum(un) AS tn FROM u {f"GROUP BY {by}" if by else ""}),
z AS (SELECT {"u." + by + ", " if by else ""}h, {z} AS z, un FROM u JOIN t ON {on}),
s AS (SELECT {keys}h, sum(z) AS s1, count(*) AS k, coalesce(var_samp(z), 0) AS v, sum(CASE WHEN un > 0 THEN 1 ELSE 0 END) AS a FROM z GROUP BY {keys}h),
q AS (SELECT {keys}sum(CASE WHEN m > 1 THEN {fpc} * m / (m - 1) * ((k - 1) * v + s1 * s1 * (1.0 / k - 1.0 / m)) ELSE 0 END) AS var,
             CAST(sum(a) - sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS BIGINT) AS df FROM s JOIN m USING (h) {f"GROUP BY {by}" if by else ""})
SELECT {keys}{more}round({est}, {digits[0]}) AS est, round(sqrt(var), {digits[1]}) AS se, df, CAST(tn AS BIGINT) AS n FROM t {f"JOIN q USING ({by})" if by else ", q"}
"""


# ---- estimation ----------------------------------------------------------------
@query("taylor_mean", linear_sql("lineitem", "l_extendedprice", "1.0"))
def taylor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir).estimation.mean("l_extendedprice").frame, ["df", "n"], est=4, se=4)


@query("mean_by", linear_sql("lineitem", "l_extendedprice", "1.0", by="l_linestatus"))
def mean_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir).estimation.mean("l_extendedprice", by="l_linestatus").frame, ["l_linestatus", "df", "n"], est=4, se=4)


@query("total_where", linear_sql("lineitem", "l_extendedprice", "1.0", ok="l_linestatus = 'O' AND l_discount > 0.09", kind="total", digits=(0, 0)))
def total_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = [{"l_linestatus": "O"}, col("l_discount") > 0.09]
    return rounded(lines(spark, sf_dir).estimation.total("l_extendedprice", where=where).frame, ["df", "n"], est=0, se=0)


@query("ratio_by", linear_sql("lineitem", "l_extendedprice", "l_tax", by="l_linestatus", kind="ratio", digits=(2, 2)))
def ratio_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir).estimation.ratio("l_extendedprice", "l_tax", by="l_linestatus").frame, ["l_linestatus", "df", "n"], est=2, se=2)


_PROP = linear_sql("lineitem", "CASE WHEN l_linestatus = '{v}' THEN 1.0 ELSE 0.0 END", "1.0", digits=(8, 8), more="'l_linestatus' AS y, '{v}' AS y_level, ")


@query("prop_levels", f"SELECT * FROM ({_PROP.format(v='F')}) UNION ALL SELECT * FROM ({_PROP.format(v='O')})")
def prop_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir).estimation.prop("l_linestatus").frame, ["y", "y_level", "df", "n"], est=8, se=8)


@query("mean_fpc", linear_sql("lineitem", "l_extendedprice", "1.0", fpc="(1000.0 - m) / 1000.0"))
def mean_fpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines(spark, sf_dir)
    s = Sample(s.data.withColumn("pop", F.lit(1000)), s.design.update(pop_size=PopSize("pop")))
    return rounded(s.estimation.mean("l_extendedprice").frame, ["df", "n"], est=4, se=4)


@query("mean_unstratified", linear_sql("orders", "o_totalprice", "1.0", w="1.0", strata="1", psu="o_custkey"))
def mean_unstratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "orders"), Design(psu="o_custkey"))
    return rounded(s.estimation.mean("o_totalprice").frame, ["df", "n"], est=4, se=4)


@query("mean_unclustered", linear_sql("(SELECT *, row_number() OVER () AS rid FROM customer)", "c_acctbal", "1.0", w="1.0", strata="c_mktsegment", psu="rid"))
def mean_unclustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "customer"), Design(stratum="c_mktsegment"))
    return rounded(s.estimation.mean("c_acctbal").frame, ["df", "n"], est=4, se=4)


@query(
    "mean_missing",
    linear_sql("lineitem", "l_extendedprice", "1.0", ok="l_discount <> 0.0"),
)
def mean_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a missing value keep their PSU in the design."""
    s = lines(spark, sf_dir)
    s = s.set_data(s.data.withColumn("y", F.when(F.col("l_discount") != 0, F.col("l_extendedprice"))))
    return rounded(s.estimation.mean("y", drop_nulls=True).frame, ["df", "n"], est=4, se=4)


@query(
    "deff_mean",
    """
WITH a AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m, count(*) AS n FROM lineitem),
s AS (SELECT sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m)) / max(w) * max(n) / (max(n) - 1) / max(n) * (1 - max(n) / max(w)) AS srs FROM lineitem, a),
u AS (SELECT l_returnflag AS h, l_suppkey AS p, sum(l_quantity * (l_extendedprice - m)) / max(w) AS z FROM lineitem, a GROUP BY ALL),
v AS (SELECT sum(x) AS var FROM (SELECT count(*) * var_samp(z) AS x FROM u GROUP BY h))
SELECT round(var / srs, 6) AS deff FROM s, v""",
)
def deff_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir).estimation.mean("l_extendedprice", deff="wor").frame, [], deff=6)


_Q = """
WITH c AS (SELECT l_linestatus, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
d AS (SELECT l_linestatus, v, sum(w) OVER (PARTITION BY l_linestatus ORDER BY v) / sum(w) OVER (PARTITION BY l_linestatus) AS cdf FROM c)
SELECT l_linestatus, p, min(v) AS est FROM d, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS q(p) WHERE cdf >= p - 1e-12 GROUP BY ALL"""


@query("quantiles_by", _Q)
def quantiles_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).estimation.quantile("l_extendedprice", by="l_linestatus").frame.select("l_linestatus", "p", "est")


@query("median_se")
def median_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Woodruff's interval needs t quantiles, which the SQL engine lacks."""
    return lines(spark, sf_dir).estimation.median("l_extendedprice").frame


@query(
    "covariance",
    """
WITH a AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my, sum(l_quantity * l_tax) / sum(l_quantity) AS mx, count(*) AS n FROM lineitem),
c AS (SELECT sum(l_quantity * (l_extendedprice - my) * (l_tax - mx)) / max(w) AS m FROM lineitem, a),
u AS (SELECT l_returnflag AS h, l_suppkey AS p, sum(l_quantity * ((l_extendedprice - my) * (l_tax - mx) - m)) / max(w) * max(n) / (max(n) - 1) AS z FROM lineitem, a, c GROUP BY ALL),
v AS (SELECT sum(x) AS var FROM (SELECT count(*) * var_samp(z) AS x FROM u GROUP BY h))
SELECT round(m * n / (n - 1), 6) AS est, round(sqrt(var), 6) AS se FROM a, c, v""",
)
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir).estimation.cov([("l_extendedprice", "l_tax")]).frame, [], est=6, se=6)


@query(
    "correlation",
    """
WITH a AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my, sum(l_quantity * l_tax) / sum(l_quantity) AS mx FROM lineitem),
c AS (SELECT sum(l_quantity * (l_extendedprice - my) * (l_tax - mx)) / max(w) AS yx, sum(l_quantity * (l_extendedprice - my) ** 2) / max(w) AS yy, sum(l_quantity * (l_tax - mx) ** 2) / max(w) AS xx FROM lineitem, a),
r AS (SELECT yx / sqrt(yy * xx) AS rho FROM c),
u AS (SELECT l_returnflag AS h, l_suppkey AS p, sum(l_quantity * ((l_extendedprice - my) * (l_tax - mx) / sqrt(yy * xx) - rho / 2 * ((l_extendedprice - my) ** 2 / yy + (l_tax - mx) ** 2 / xx))) / max(w) AS z FROM lineitem, a, c, r GROUP BY ALL),
v AS (SELECT sum(x) AS var FROM (SELECT count(*) * var_samp(z) AS x FROM u GROUP BY h))
SELECT round(rho, 9) AS est, round(sqrt(var), 9) AS se FROM r, v""",
)
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines(spark, sf_dir).estimation.corr([("l_extendedprice", "l_tax")]).frame, [], est=9, se=9)


# ---- replication -----------------------------------------------------------------
@query(
    "jackknife_mean",
    """
WITH u AS (SELECT c_mktsegment AS h, c_nationkey AS p, sum(abs(c_acctbal) + 1) AS w, sum((abs(c_acctbal) + 1) * c_acctbal) AS wy FROM customer GROUP BY ALL),
m AS (SELECT h, count(*) AS m, sum(w) AS hw, sum(wy) AS hy FROM u GROUP BY h),
t AS (SELECT sum(w) AS w, sum(wy) AS wy FROM u),
r AS (SELECT u.h, p, m, (t.wy - hy + (hy - u.wy) * m / (m - 1)) / (t.w - hw + (hw - u.w) * m / (m - 1)) AS theta FROM u JOIN m USING (h), t),
c AS (SELECT avg(theta) AS c FROM r)
SELECT round(max(t.wy / t.w), 4) AS est, round(sqrt(sum((m - 1.0) / m * (theta - c) ** 2)), 4) AS se FROM r, c, t""",
)
def jackknife_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = customers(spark, sf_dir).weighting.create_jk_wgts(as_array=True)
    return rounded(s.estimation.mean("c_acctbal", method="replication").frame, [], est=4, se=4)


@query(
    "brr_mean",
    """
WITH u AS (SELECT o_orderpriority AS h, o_orderkey % 2 AS p, count(*) AS w, sum(o_totalprice) AS wy FROM orders GROUP BY ALL),
k AS (SELECT h, row_number() OVER (ORDER BY h) AS i FROM (SELECT DISTINCT h FROM u)),
r AS (SELECT r.r, sum(CASE WHEN (bit_count(i & r.r) % 2 = 0) = (p = 0) THEN 2 * wy ELSE 0 END) / sum(CASE WHEN (bit_count(i & r.r) % 2 = 0) = (p = 0) THEN 2 * w ELSE 0 END) AS theta
      FROM u JOIN k USING (h), range(8) AS r(r) GROUP BY r.r),
c AS (SELECT avg(theta) AS c FROM r)
SELECT round((SELECT sum(wy) / sum(w) FROM u), 4) AS est, round(sqrt(sum((theta - c) ** 2) / 8), 4) AS se FROM r, c""",
)
def brr_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of order 8 is that of Sylvester, whose entries are parities of i & r."""
    s = half(spark, sf_dir).weighting.create_brr_wgts(as_array=True)
    return rounded(s.estimation.mean("o_totalprice", method="replication").frame, [], est=4, se=4)


@query("bootstrap_ratio")
def bootstrap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = customers(spark, sf_dir).weighting.create_bs_wgts(50, rstate=1, as_array=True)
    return s.estimation.ratio("c_acctbal", "w", method="replication", by="c_mktsegment").frame


@query("sdr_total")
def sdr_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = customers(spark, sf_dir).weighting.create_sdr_wgts(8, as_array=True)
    return s.estimation.total("c_acctbal", method="replication").frame


# ---- weighting ---------------------------------------------------------------------
@query("normalize_by", "SELECT c_custkey, round((abs(c_acctbal) + 1) / sum(abs(c_acctbal) + 1) OVER (PARTITION BY c_mktsegment) * count(*) OVER (PARTITION BY c_mktsegment), 8) AS norm_wgt FROM customer")
def normalize_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(customers(spark, sf_dir).weighting.normalize(by="c_mktsegment").data, ["c_custkey"], norm_wgt=8)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_CTRL = ", ".join(f"('{s}', {1000.0 + 100 * k})" for k, s in enumerate(SEGMENTS))


@query("poststratify", f"SELECT c_custkey, round((abs(c_acctbal) + 1) * t / sum(abs(c_acctbal) + 1) OVER (PARTITION BY c_mktsegment), 8) AS ps_wgt FROM customer JOIN (VALUES {_CTRL}) AS c(s, t) ON s = c_mktsegment")
def poststratify(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = {s: 1000.0 + 100 * k for k, s in enumerate(SEGMENTS)}
    return rounded(customers(spark, sf_dir).weighting.poststratify(controls, by="c_mktsegment").data, ["c_custkey"], ps_wgt=8)


@query(
    "nonresponse",
    """
WITH b AS (SELECT c_custkey, c_mktsegment, abs(c_acctbal) + 1 AS w, CASE WHEN c_custkey % 5 = 0 THEN 'nr' WHEN c_custkey % 7 = 0 THEN 'uk' WHEN c_custkey % 11 = 0 THEN 'in' ELSE 'rr' END AS st FROM customer),
s AS (SELECT c_mktsegment, sum(CASE st WHEN 'rr' THEN w ELSE 0 END) AS rr, sum(CASE st WHEN 'nr' THEN w ELSE 0 END) AS nr, sum(CASE st WHEN 'in' THEN w ELSE 0 END) AS inn, sum(CASE st WHEN 'uk' THEN w ELSE 0 END) AS uk FROM b GROUP BY 1)
SELECT c_custkey, round(w * (rr + nr) / rr * (inn + rr + nr + uk) / (inn + rr + nr), 6) AS nr_wgt FROM b JOIN s USING (c_mktsegment) WHERE st = 'rr'""",
)
def nonresponse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = customers(spark, sf_dir)
    k = F.col("c_custkey")
    s = s.set_data(s.data.withColumn("st", F.when(k % 5 == 0, "nr").when(k % 7 == 0, "uk").when(k % 11 == 0, "in").otherwise("rr")))
    return rounded(s.weighting.adjust("st", "c_mktsegment").data, ["c_custkey"], nr_wgt=6)


def _rake_sql(passes: int) -> str:
    out = "WITH w0 AS (SELECT c_custkey, c_mktsegment, c_nationkey, abs(c_acctbal) + 1 AS w FROM customer)"
    for k in range(passes):
        out += f", a{k} AS (SELECT * REPLACE (w * 1000.0 / sum(w) OVER (PARTITION BY c_mktsegment) AS w) FROM w{k}), w{k + 1} AS (SELECT * REPLACE (w * 200.0 / sum(w) OVER (PARTITION BY c_nationkey) AS w) FROM a{k})"
    return f"{out} SELECT c_custkey, round(w, 4) AS rk_wgt FROM w{passes}"


@query("rake", _rake_sql(25))
def rake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converged to 1e-10, where further passes of the SQL change nothing that is shown."""
    controls = {"c_mktsegment": {s: 1000.0 for s in SEGMENTS}, "c_nationkey": {k: 200.0 for k in range(25)}}
    return rounded(customers(spark, sf_dir).weighting.rake(controls=controls, tol=1e-10).data, ["c_custkey"], rk_wgt=4)


@query("calibrate", f"SELECT c_custkey, round((abs(c_acctbal) + 1) * t / sum(abs(c_acctbal) + 1) OVER (PARTITION BY c_mktsegment), 6) AS calib_wgt FROM customer JOIN (VALUES {_CTRL}) AS c(s, t) ON s = c_mktsegment")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On one category, linear calibration is poststratification."""
    controls = {Cat("c_mktsegment"): {s: 1000.0 + 100 * k for k, s in enumerate(SEGMENTS)}}
    return rounded(customers(spark, sf_dir).weighting.calibrate(controls=controls).data, ["c_custkey"], calib_wgt=6)


@query(
    "trim_once",
    """
WITH b AS (SELECT c_custkey, abs(c_acctbal) + 1 AS w FROM customer)
SELECT c_custkey, round(least(w, 9000.0), 6) AS trim_wgt FROM b""",
)
def trim_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(customers(spark, sf_dir).weighting.trim(upper=9000.0, redistribute=False).data, ["c_custkey"], trim_wgt=6)


@query("trim_redistribute")
def trim_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).weighting.trim(upper=0.95).data.select("c_custkey", "trim_wgt")


# ---- tables, tests and models -------------------------------------------------------
@query(
    "crosstab",
    "SELECT l_returnflag AS \"row\", l_linestatus AS col, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 9) AS est FROM lineitem GROUP BY ALL",
)
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lines(spark, sf_dir).categorical.tabulate("l_returnflag", "l_linestatus")
    rows = [(c["row"], c["col"], round(c["est"], 9)) for c in table.cells]
    return spark.createDataFrame(rows, "row string, col string, est double")


@query("crosstab_test")
def crosstab_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = lines(spark, sf_dir).categorical.tabulate("l_returnflag", "l_linestatus").stats
    return spark.createDataFrame([(k, float(v)) for k, v in stats.items()], "stat string, value double")


@query(
    "ttest_groups",
    """
WITH t AS (SELECT l_linestatus AS g, sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM lineitem GROUP BY 1),
u AS (SELECT l_returnflag AS h, l_suppkey AS p, sum(CASE g WHEN 'O' THEN 1 ELSE -1 END * l_quantity * (l_extendedprice - m) / w) AS z FROM lineitem JOIN t ON g = l_linestatus GROUP BY ALL),
v AS (SELECT sum(x) AS var FROM (SELECT count(*) * var_samp(z) AS x FROM u GROUP BY h))
SELECT round(max(CASE g WHEN 'O' THEN m END) - max(CASE g WHEN 'F' THEN m END), 4) AS diff, round(sqrt(max(var)), 4) AS se FROM t, v""",
)
def ttest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lines(spark, sf_dir).categorical.ttest("l_extendedprice", group="l_linestatus").rows[0]
    return spark.createDataFrame([(round(r["diff"], 4), round(r["se"], 4))], "diff double, se double")


@query("ranktest_groups")
def ranktest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lines(spark, sf_dir).categorical.ranktest("l_extendedprice", group="l_returnflag").rows[0]
    return spark.createDataFrame([(float(r["chisq"]), float(r["p_value"]))], "chisq double, p_value double")


@query(
    "glm_gaussian",
    """
WITH a AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my, sum(l_quantity * l_tax) / sum(l_quantity) AS mx FROM lineitem),
b AS (SELECT sum(l_quantity * (l_tax - mx) * (l_extendedprice - my)) / sum(l_quantity * (l_tax - mx) ** 2) AS b, sum(l_quantity * (l_tax - mx) ** 2) AS sxx FROM lineitem, a),
u AS (SELECT l_returnflag AS h, l_suppkey AS p, sum(l_quantity * (l_extendedprice - my - b * (l_tax - mx)) * (l_tax - mx)) / max(sxx) AS z FROM lineitem, a, b GROUP BY ALL),
v AS (SELECT sum(x) AS var FROM (SELECT count(*) * var_samp(z) AS x FROM u GROUP BY h))
SELECT 'l_tax' AS term, round(b, 3) AS est, round(sqrt(var), 3) AS se FROM b, v""",
)
def glm_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(spark, sf_dir).glm.fit("l_extendedprice", x="l_tax").coefs[1]
    return spark.createDataFrame([(c["term"], round(c["est"], 3), round(c["se"], 3))], "term string, est double, se double")


@query("glm_logit")
def glm_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines(spark, sf_dir)
    s = s.set_data(s.data.withColumn("open", (F.col("l_linestatus") == "O").cast("int")))
    return s.glm.fit("open", x=["l_tax", Cat("l_returnflag")], family="binomial").to_df()


# ---- description and preparation ------------------------------------------------------
@query(
    "describe_numbers",
    "SELECT round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, round(quantile_cont(c_acctbal, 0.25), 6) AS p25, round(quantile_cont(c_acctbal, 0.75), 6) AS p75 FROM customer",
)
def describe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = customers(spark, sf_dir).describe("c_acctbal")["c_acctbal"]
    row = (round(r["mean"], 6), round(r["std"], 6), r["min"], r["max"], round(r["p25"], 6), round(r["p75"], 6))
    return spark.createDataFrame([row], "mean double, std double, min double, max double, p25 double, p75 double")


@query("describe_levels", "SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")
def describe_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.operators.describe import frequencies

    return frequencies(read(spark, sf_dir, "orders"), "o_orderpriority", None, F.lit(1.0)).select("value", "n", F.round("share", 9).alias("share"))


@query(
    "wrangle_values",
    """
SELECT c_custkey, least(c_acctbal, 5000.0) AS topped, greatest(least(c_acctbal, 5000.0), 0.0) AS clamped,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'HEAVY' ELSE c_mktsegment END AS segment,
       CASE WHEN c_acctbal >= -1000 AND c_acctbal <= 0 THEN 'low' WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN 'mid' WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 'high' END AS band
FROM customer WHERE c_nationkey <> 3""",
)
def wrangle_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = customers(spark, sf_dir).wrangling.filter_records({"c_nationkey": 3}, negate=True)
    w = w.wrangling.top_code({"c_acctbal": 5000.0}, into="topped").wrangling.bottom_and_top_code({"c_acctbal": (0.0, 5000.0)}, into="clamped")
    w = w.wrangling.recode("c_mktsegment", {"HEAVY": ["BUILDING", "MACHINERY"]}, into="segment")
    w = w.wrangling.categorize("c_acctbal", [-1000, 0, 5000, 10000], ["low", "mid", "high"], into="band")
    return w.data.select("c_custkey", "topped", "clamped", "segment", "band")


@query(
    "expressions",
    """
SELECT o_orderkey, round(ln(o_totalprice + 1), 8) AS l, floor(o_totalprice / 1000) AS k, o_orderkey % 7 AS m, upper(o_orderstatus) || '-' || o_orderpriority AS s,
       year(o_orderdate) AS y, quarter(o_orderdate) AS q, isodow(o_orderdate) AS d, strftime(o_orderdate, '%Y/%m/%d') AS f,
       CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS c, length(o_orderpriority) AS n, substr(o_orderpriority, 1, 1) AS h, o_orderpriority LIKE '%URGENT%' AS u
FROM orders""",
)
def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "orders"))
    price, date, prio = col("o_totalprice"), col("o_orderdate"), col("o_orderpriority")
    made = s.wrangling.mutate(
        {
            "l": (price + 1).log().round(8),
            "k": (price // 1000).to_float(),
            "m": (col("o_orderkey") % 7).to_int(),
            "s": concat_str(col("o_orderstatus").upper(), prio, separator="-"),
            "y": date.dt_year().cast("bigint"),
            "q": date.dt_quarter().cast("bigint"),
            "d": date.dt_weekday().cast("bigint"),
            "f": date.dt_strftime("%Y/%m/%d"),
            "c": when(price > 200000).then(lit("big")).otherwise(lit("small")),
            "n": prio.str_len().cast("bigint"),
            "h": prio.head(1),
            "u": prio.contains("URGENT", literal=True),
        }
    )
    return made.data.select("o_orderkey", *"l k m s y q d f c n h u".split())


@query(
    "windows",
    """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id), 6) AS total, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r,
       rank() OVER (PARTITION BY user_id ORDER BY event_type) AS low, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dense,
       round(value - avg(value) OVER (PARTITION BY event_type), 6) AS gap, round(value / sum(value) OVER (), 9) AS share
FROM events""",
)
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "events").orderBy("event_id"))
    value = col("value")
    made = s.wrangling.mutate(
        {
            "total": value.sum().over("user_id").round(6),
            "r": value.rank().over("user_id").cast("bigint"),
            "low": col("event_type").rank("min").over("user_id").cast("bigint"),
            "dense": col("event_type").rank("dense").over("user_id").cast("bigint"),
            "gap": (value - value.mean().over("event_type")).round(6),
            "share": (value / value.sum()).round(9),
        }
    )
    return made.data.select("event_id", "total", "r", "low", "dense", "gap", "share")


@query(
    "horizontal",
    "SELECT l_orderkey, l_linenumber, round(coalesce(l_tax, 0) + coalesce(nullif(l_discount, 0.0), 0), 9) AS s, greatest(l_tax, l_discount) AS m, coalesce(nullif(l_discount, 0.0), l_tax) AS c FROM lineitem",
)
def horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "lineitem").withColumn("d", F.nullif("l_discount", F.lit(0.0))))
    made = s.wrangling.mutate({"s": sum_horizontal("l_tax", "d").round(9), "m": max_horizontal("l_tax", "l_discount"), "c": coalesce("d", "l_tax")})
    return made.data.select("l_orderkey", "l_linenumber", "s", "m", "c")


@query("distinct_rows", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber"))
    return s.wrangling.distinct("l_orderkey", keep="first", maintain_order=False).data


@query("fill_nulls", "SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_discount, 0.0), (SELECT avg(nullif(l_discount, 0.0)) FROM lineitem)), 9) AS d FROM lineitem")
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "lineitem").withColumn("d", F.nullif("l_discount", F.lit(0.0))))
    return rounded(s.wrangling.fill_null("d", strategy="mean").data, ["l_orderkey", "l_linenumber"], d=9)


# ---- selection ---------------------------------------------------------------------------
@query("srs_counts", "SELECT p_brand, CAST(least(count(*), 5) AS BIGINT) AS n, round(least(count(*), 5) / count(*), 9) AS prob, round(count(*) / least(count(*), 5), 6) AS wgt FROM part GROUP BY 1")
def srs_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows are drawn depends on the seed; how many and with what probability does not."""
    s = Sample(read(spark, sf_dir, "part"), Design(stratum="p_brand")).sampling.srs(5, rstate=7)
    return s.data.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.max("survey_prob_selection"), 9).alias("prob"), F.round(F.max("survey_sample_weight"), 6).alias("wgt"))


@query("pps_counts", "SELECT p_brand, CAST(4 AS BIGINT) AS hits FROM part GROUP BY 1")
def pps_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "part"), Design(stratum="p_brand", mos="p_size")).sampling.pps_sys(4, rstate=7)
    return s.data.groupBy("p_brand").agg(F.sum("survey_number_of_hits").alias("hits"))


@query("pps_brewer")
def pps_brewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample(read(spark, sf_dir, "part"), Design(stratum="p_brand", mos="p_size")).sampling.pps_brewer(4, rstate=7)
    return s.data.select("p_partkey", "survey_prob_selection", "survey_sample_weight")


@query("group_sizes", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = Sample(read(spark, sf_dir, "part"), Design(stratum="p_brand")).sampling.group_sizes()
    return spark.createDataFrame(list(sizes.items()), "p_brand string, n bigint")


# ---- singletons ----------------------------------------------------------------------------
def _lone(spark: SparkSession, sf_dir: str) -> Sample:
    s = customers(spark, sf_dir)
    return s.set_data(s.data.withColumn("c_nationkey", F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(F.col("c_nationkey"))))


_LONE = "(SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE c_nationkey END AS c_nationkey), abs(c_acctbal) + 1 AS w FROM customer)"


@query("singleton_profile", f"SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_psus, count(*) AS n_rows, count(DISTINCT c_nationkey) = 1 AS is_singleton FROM {_LONE} GROUP BY 1")
def singleton_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lone(spark, sf_dir).singleton.strata_profile().select("c_mktsegment", "n_psus", "n_rows", "is_singleton")


@query(
    "singleton_center",
    f"""
WITH a AS (SELECT sum(w) AS w, sum(w * c_acctbal) / sum(w) AS m FROM {_LONE}),
u AS (SELECT c_mktsegment AS h, c_nationkey AS p, sum(b.w * (c_acctbal - m)) / max(a.w) AS z FROM {_LONE} AS b, a GROUP BY ALL),
g AS (SELECT avg(z) AS g FROM u),
v AS (SELECT CASE WHEN count(*) > 1 THEN count(*) * var_samp(z) ELSE max((z - g) ** 2) END AS x FROM u, g GROUP BY h)
SELECT round(sqrt(sum(x)), 4) AS se FROM v""",
)
def singleton_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_lone(spark, sf_dir).singleton.center().estimation.mean("c_acctbal").frame, [], se=4)


@query("variance_contributions", f"WITH u AS (SELECT c_mktsegment, c_nationkey, sum(w * c_acctbal) AS t FROM {_LONE} GROUP BY ALL) SELECT c_mktsegment, count(*) AS n_psus, round(CASE WHEN count(*) > 1 THEN count(*) * var_samp(t) END / 1e9, 3) AS contribution FROM u GROUP BY 1")
def variance_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lone(spark, sf_dir).singleton.variance_contributions("c_acctbal")
    return out.select("c_mktsegment", "n_psus", F.round(F.col("contribution") / 1e9, 3).alias("contribution"))
