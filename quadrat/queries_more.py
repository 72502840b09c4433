"""Further driver queries with SQL: every expression method by family, estimates and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.design import Design
from quadrat.functions.expr import all_horizontal, any_horizontal, col, lit, min_horizontal, struct, when
from quadrat.functions.terms import Cat
from quadrat.queries import _LONE, _lone, linear_sql, lines, query, read, rounded
from quadrat.sample import Sample


def made(df: DataFrame, keys: list[str], **specs) -> DataFrame:
    """``keys`` and the columns that ``specs`` describe."""
    return Sample(df).wrangling.mutate(specs).data.select(*keys, *specs)


# ---- expressions ---------------------------------------------------------------
@query(
    "expr_numbers",
    """
SELECT c_custkey, abs(x) AS absolute, round(ln(a), 9) AS ln, round(log10(a), 9) AS ten, round(log2(a), 9) AS two, round(ln(a) / ln(3), 9) AS three, round(exp(x / 10000), 9) AS e,
       round(sqrt(a), 9) AS root, round(cbrt(a), 9) AS third, round(pow(a, 1.5), 6) AS power, round(x, 1) AS r, floor(x) AS low, ceil(x) AS high, CAST(sign(x) AS DOUBLE) AS s,
       least(greatest(x, 0.0), 5000.0) AS c, round(sin(x), 8) AS sine, round(cos(x), 8) AS cosine, round(tan(x / 20000), 9) AS tangent, round(asin(x / 20000), 9) AS asine,
       round(acos(x / 20000), 9) AS acosine, round(atan(x), 9) AS atangent, round(radians(x), 8) AS rad, round(degrees(x / 1000), 6) AS deg,
       floor(x / 7) AS whole, c_custkey - 7 * floor(c_custkey / 7.0) AS rest, round(-x / 3 + 2 * x - 1, 6) AS mixed
FROM (SELECT c_custkey, c_acctbal AS x, abs(c_acctbal) + 1 AS a FROM customer)""",
)
def expr_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = col("c_acctbal")
    a = x.abs() + 1
    return made(
        read(spark, sf_dir, "customer"), ["c_custkey"], absolute=x.abs(), ln=a.log().round(9), ten=a.log10().round(9), two=a.log2().round(9), three=a.log(3).round(9),
        e=(x / 10000).exp().round(9), root=a.sqrt().round(9), third=a.cbrt().round(9), power=a.pow(1.5).round(6), r=x.round(1), low=x.floor(), high=x.ceil(), s=x.sign(),
        c=x.clip(0.0, 5000.0), sine=x.sin().round(8), cosine=x.cos().round(8), tangent=(x / 20000).tan().round(9), asine=(x / 20000).arcsin().round(9),
        acosine=(x / 20000).arccos().round(9), atangent=x.arctan().round(9), rad=x.radians().round(8), deg=(x / 1000).degrees().round(6),
        whole=(x // 7).to_float(), rest=(col("c_custkey") % 7).to_float(), mixed=(-x / 3 + 2 * x - 1).round(6),
    )


@query(
    "expr_missing",
    """
SELECT c_custkey, x IS NULL AS gone, x IS NOT NULL AS there, isnan(x) AS nan, NOT isnan(x) AS number, isfinite(x) AS finite, isinf(x) AS infinite,
       coalesce(x, -1.0) AS filled, CASE WHEN isnan(x) THEN 0.5 ELSE x END AS unnanned, c_nationkey IN (1, 2, 3) AS member, c_nationkey NOT IN (1, 2, 3) AS other,
       c_nationkey BETWEEN 5 AND 9 AS inside, c_nationkey > 5 AND c_nationkey <= 9 AS half, CAST(c_nationkey AS VARCHAR) AS text, c_nationkey <> 0 AS truth,
       CAST(trunc(c_acctbal) AS BIGINT) AS n, CAST(c_nationkey AS DOUBLE) AS f, x IS NULL OR c_nationkey > 10 AS either, c_nationkey > 10 AND c_acctbal > 0 AS both, least(c_acctbal, c_nationkey) AS lesser, c_nationkey + 1 AS field
FROM (SELECT *, CASE WHEN c_nationkey = 3 THEN 'nan'::DOUBLE WHEN c_nationkey = 4 THEN NULL WHEN c_nationkey = 5 THEN 'inf'::DOUBLE ELSE c_acctbal END AS x FROM customer)""",
)
def expr_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, n = col("x"), col("c_nationkey")
    value = when(n == 3).then(lit(float("nan"))).when(n == 4).then(lit(None)).when(n == 5).then(lit(float("inf"))).otherwise(col("c_acctbal"))
    out = made(
        read(spark, sf_dir, "customer"), ["c_custkey"], x=value, gone=x.is_null(), there=x.is_not_null(), nan=x.is_nan(), number=x.is_not_nan(), finite=x.is_finite(), infinite=x.is_infinite(),
        filled=x.fill_null(-1.0), unnanned=x.fill_nan(0.5), member=n.is_in([1, 2, 3]), other=n.is_not_in([1, 2, 3]), inside=n.between(5, 9), half=n.between(5, 9, closed="right"),
        text=n.to_str(), truth=n.to_bool(), n=col("c_acctbal").to_int(), f=n.to_float(), either=any_horizontal(x.is_null(), n > 10), both=all_horizontal(n > 10, col("c_acctbal") > 0), lesser=min_horizontal("c_acctbal", n.to_float()),
        s=struct(field=n + 1),
    )
    return out.withColumn("field", F.col("s.field")).drop("s", "x")


@query(
    "expr_text",
    """
SELECT p_partkey, length(p_name) AS n, octet_length(encode(p_name)) AS bytes, lower(p_brand) AS low, upper(p_name) AS up,
       array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS titled, trim('  ' || p_name || ' ') AS bare, ltrim('  ' || p_name || ' ') AS l, rtrim('  ' || p_name || ' ') AS r,
       trim(p_brand, 'Bd') AS stripped, regexp_matches(p_name, 'w.d') AS found, starts_with(p_name, 'co') AS starts, ends_with(p_name, 'et') AS ends,
       regexp_replace(p_name, '[aeiou]', '_') AS one, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, replace(p_brand, '#', '-') AS literal, substr(p_name, 2, 3) AS part, right(p_name, 3) AS last3,
       left(p_name, 4) AS first4, right(p_name, 2) AS tail2, p_brand || '/' || p_type AS joined, CASE WHEN length(p_type) < 9 THEN lpad(p_type, 9, '*') ELSE p_type END AS padl, CASE WHEN length(p_type) < 9 THEN rpad(p_type, 9, '*') ELSE p_type END AS padr,
       nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS digits, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels
FROM part""",
)
def expr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b, k = col("p_name"), col("p_brand"), col("p_type")
    df = read(spark, sf_dir, "part").withColumn("q", F.concat(F.lit("  "), "p_name", F.lit(" ")))
    q = col("q")
    return made(
        df, ["p_partkey"], n=t.str_len().to_int(), bytes=t.str_len_bytes().to_int(), low=b.lower(), up=t.upper(), titled=t.title(), bare=q.strip(), l=q.lstrip(), r=q.rstrip(),
        stripped=b.strip("Bd"), found=t.contains("w.d"), starts=t.startswith("co"), ends=t.endswith("et"), one=t.replace("[aeiou]", "_"), every=t.replace_all("[aeiou]", "_"), literal=b.replace_all("#", "-", literal=True),
        part=t.slice(1, 3), last3=t.slice(-3), first4=t.head(4), tail2=t.tail(2), joined=b.concat(k, separator="/"), padl=k.pad_left(9, "*"), padr=k.pad_right(9, "*"),
        digits=b.extract("([0-9]+)"), vowels=t.count_matches("[aeiou]").to_int(),
    )


@query(
    "expr_dates",
    """
SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, isodow(ts) AS wd, weekofyear(ts) AS wk, dayofyear(ts) AS od, quarter(ts) AS q,
       CAST(ts AS DATE) AS dt, strftime(ts, '%H:%M:%S.%f') AS tm, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ep, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, strftime(ts, '%d.%m.%Y %H:%M') AS f,
       strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS th, strftime(date_trunc('month', ts), '%Y-%m-%d') AS tmo, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%H:%M') AS t15
FROM events""",
)
def expr_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = col("ts")
    n = {k: v.to_int() for k, v in {"y": t.dt_year(), "mo": t.dt_month(), "d": t.dt_day(), "h": t.dt_hour(), "mi": t.dt_minute(), "s": t.dt_second(), "wd": t.dt_weekday(), "wk": t.dt_week(), "od": t.dt_ordinal_day(), "q": t.dt_quarter()}.items()}
    return made(
        read(spark, sf_dir, "events"), ["event_id"], **n, dt=t.dt_date(), tm=t.dt_time(), ep=t.dt_epoch(), ms=t.dt_epoch("ms"), f=t.dt_strftime("%d.%m.%Y %H:%M"),
        th=t.dt_truncate("1h").dt_strftime("%Y-%m-%d %H:%M:%S"), tmo=t.dt_truncate("1mo").dt_strftime("%Y-%m-%d"), t15=t.dt_truncate("15m").dt_strftime("%H:%M"),
    )


@query(
    "expr_lists",
    """
SELECT p_partkey, len(w) AS n, w[1] AS first, w[-1] AS last, w[2] AS second, list_contains(w, 'widget') AS has, array_to_string(w, '+') AS joined, array_to_string(list_sort(w), '+') AS ordered, array_to_string(list_reverse(w), '+') AS turned,
       round(list_sum(v), 6) AS total, round(list_avg(v), 6) AS mean, list_min(v) AS low, list_max(v) AS high, len(list_distinct(v)) AS kinds
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, [p_retailprice, p_size, p_size] AS v FROM part)""",
)
def expr_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").withColumn("v", F.array("p_retailprice", F.col("p_size").cast("double"), F.col("p_size").cast("double")))
    w, v = col("p_name").split(" "), col("v")
    return made(
        df, ["p_partkey"], n=w.list_len().to_int(), first=w.list_first(), last=w.list_last(), second=w.list_get(1), has=w.list_contains("widget"), joined=w.list_join("+"), ordered=w.list_sort().list_join("+"),
        turned=w.list_reverse().list_join("+"), total=v.list_sum().round(6), mean=v.list_mean().round(6), low=v.list_min(), high=v.list_max(), kinds=v.list_unique().list_len().to_int(),
    )


@query(
    "expr_aggregates",
    """
SELECT event_id, round(sum(v) OVER w, 6) AS s, round(avg(v) OVER w, 6) AS m, round(median(v) OVER w, 6) AS med, min(v) OVER w AS low, max(v) OVER w AS high, round(stddev_samp(v) OVER w, 6) AS sd, round(var_samp(v) OVER w, 3) AS var,
       round(var_pop(v) OVER w, 3) AS var0, count(v) OVER w AS n, count(*) OVER w AS rows, count(*) OVER w - count(v) OVER w AS nulls, first_value(v) OVER o AS first, last_value(v) OVER o AS last,
       k.kinds, k.mode, round(quantile_cont(v, 0.3) OVER w, 6) AS q, quantile_disc(v, 0.0) OVER w AS q0, round(CASE WHEN count(v) OVER w > 2 THEN stddev_pop(v) OVER w * sqrt(count(v) OVER w / (count(v) OVER w - 2)) END, 3) AS sd2, round(exp(sum(ln(1 + event_id % 3)) OVER w), 0) AS p
FROM (SELECT *, CASE WHEN event_id % 7 > 0 THEN value END AS v FROM events WHERE event_id % 50 < 5) AS e
JOIN (SELECT user_id, count(DISTINCT event_type) AS kinds, min(event_type) FILTER (c = top) AS mode FROM (SELECT *, max(c) OVER (PARTITION BY user_id) AS top FROM (SELECT user_id, event_type, count(*) AS c FROM events WHERE event_id % 50 < 5 GROUP BY ALL)) GROUP BY 1) AS k USING (user_id)
WINDOW w AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def expr_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of the rows keeps products within doubles."""
    df = read(spark, sf_dir, "events").where("event_id % 50 < 5").withColumns({"v": F.expr("CASE WHEN event_id % 7 > 0 THEN value END"), "z": F.expr("1.0D + event_id % 3")}).orderBy("event_id")
    v, t = col("v"), col("event_type")
    by = lambda e: e.over("user_id")
    return made(
        df, ["event_id"], s=by(v.sum()).round(6), m=by(v.mean()).round(6), med=by(v.median()).round(6), low=by(v.min()), high=by(v.max()), sd=by(v.std()).round(6), var=by(v.var()).round(3), var0=by(v.var(0)).round(3),
        n=by(v.count()), rows=by(v.len()), nulls=by(v.null_count()), first=by(v.first()), last=by(v.last()), kinds=by(t.n_unique()).to_int(), mode=by(t.mode()), q=by(v.quantile(0.3, "linear")).round(6), q0=by(v.quantile(0.0)), sd2=by(v.std(2)).round(3), p=by(col("z").product()).round(0),
    )


@query(
    "expr_running",
    """
SELECT event_id, round(sum(value) OVER r, 6) AS total, min(value) OVER r AS low, max(value) OVER r AS high, count(value) OVER r AS n, lag(value, 1) OVER o AS before, coalesce(lead(value, 2) OVER o, -1.0) AS after,
       round(value - lag(value) OVER o, 6) AS step, round(value / lag(value) OVER o - 1, 9) AS change, CASE WHEN count(*) OVER k = 3 THEN round(avg(value) OVER k, 6) END AS mean3, CASE WHEN count(*) OVER k = 3 THEN round(sum(value) OVER k, 6) END AS sum3,
       CASE WHEN count(*) OVER k = 3 THEN round(stddev_samp(value) OVER k, 5) END AS sd3, CASE WHEN count(*) OVER k = 3 THEN min(value) OVER k END AS min3, CASE WHEN count(*) OVER k = 3 THEN max(value) OVER k END AS max3,
       rank() OVER (PARTITION BY user_id ORDER BY event_type) + count(*) OVER (PARTITION BY user_id, event_type) - 1 AS top, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS falling
FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id), r AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)""",
)
def expr_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = col("value")
    by = lambda e: e.over("user_id")
    return made(
        read(spark, sf_dir, "events").orderBy("event_id"), ["event_id"], total=by(v.cum_sum()).round(6), low=by(v.cum_min()), high=by(v.cum_max()), n=by(v.cum_count()), before=by(v.shift(1)), after=by(v.shift(-2, fill_value=-1.0)),
        step=by(v.diff()).round(6), change=by(v.pct_change()).round(9), mean3=by(v.rolling_mean(3)).round(6), sum3=by(v.rolling_sum(3)).round(6), sd3=by(v.rolling_std(3)).round(5), min3=by(v.rolling_min(3)), max3=by(v.rolling_max(3)),
        top=by(col("event_type").rank("max")).to_int(), falling=by(v.rank(descending=True)).to_int(),
    )


@query(
    "expr_positions",
    """
WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS j, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events)
SELECT a.event_id, b.value AS sorted, c.value AS turned, b.i - 1 AS at FROM e AS a JOIN e AS b ON a.user_id = b.user_id AND a.i = b.k JOIN e AS c ON a.user_id = c.user_id AND a.i = c.j""",
)
def expr_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").orderBy("event_id")
    v = col("value")
    return made(df, ["event_id"], sorted=v.sort().over("user_id"), turned=v.reverse().over("user_id"), at=v.arg_sort().over("user_id"))


@query(
    "expr_ewm",
    """
WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT event_id, user_id, i, value AS n, 1.0::DOUBLE AS d, 1.0::DOUBLE AS c, value AS p FROM e WHERE i = 1
      UNION ALL SELECT e.event_id, e.user_id, e.i, s.n * 0.5 + e.value, s.d * 0.5 + 1, s.c + 1, s.p FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, round(n / d, 6) AS smooth FROM s""",
)
def expr_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(read(spark, sf_dir, "events").orderBy("event_id"), ["event_id"], smooth=col("value").ewm_mean(alpha=0.5).over("user_id").round(6))


# ---- tests, models, two stages -------------------------------------------------------
@query(
    "ttest_paired",
    linear_sql("lineitem", "l_tax - l_discount", "1.0").replace("round(ty / tx, 4) AS est, round(sqrt(var), 4) AS se, df, CAST(tn AS BIGINT) AS n", "round(ty / tx, 8) AS diff, round(sqrt(var), 8) AS se, round(ty / tx / sqrt(var), 4) AS t"),
)
def ttest_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lines(spark, sf_dir).categorical.ttest("l_tax", y_pair="l_discount").rows[0]
    return spark.createDataFrame([(round(r["diff"], 8), round(r["se"], 8), round(r["t"], 4))], "diff double, se double, t double")


@query("glm_predict", """
WITH a AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my, sum(l_quantity * l_tax) / sum(l_quantity) AS mx FROM lineitem),
b AS (SELECT sum(l_quantity * (l_tax - mx) * (l_extendedprice - my)) / sum(l_quantity * (l_tax - mx) ** 2) AS b FROM lineitem, a)
SELECT DISTINCT l_tax, round(my + b * (l_tax - mx), 3) AS fit FROM lineitem, a, b""")
def glm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines(spark, sf_dir)
    model = s.glm.fit("l_extendedprice", x="l_tax")
    return model.predict(read(spark, sf_dir, "lineitem").select("l_tax").distinct()).select("l_tax", F.round("yhat", 3).alias("fit"))


@query("glm_poisson_means", "SELECT l_returnflag AS level, round(sum(l_quantity * l_linenumber) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def glm_poisson_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Poisson model of one category has the groups' means as fitted values."""
    s = lines(spark, sf_dir)
    model = s.glm.fit("l_linenumber", x=[Cat("l_returnflag")], family="poisson")
    levels = read(spark, sf_dir, "lineitem").select("l_returnflag").distinct()
    return model.predict(levels).select(F.col("l_returnflag").alias("level"), F.round("yhat", 6).alias("mean"))


@query("singleton_skip", f"""
WITH a AS (SELECT sum(w) AS w, sum(w * c_acctbal) / sum(w) AS m FROM {_LONE} WHERE c_mktsegment <> 'BUILDING'),
u AS (SELECT c_mktsegment AS h, c_nationkey AS p, sum(b.w * (c_acctbal - m)) / max(a.w) AS z FROM {_LONE} AS b, a WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL),
v AS (SELECT count(*) * var_samp(z) AS x FROM u GROUP BY h)
SELECT round(sqrt(sum(x)), 4) AS se FROM v""")
def singleton_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata with one PSU add nothing to the variance."""
    return rounded(_lone(spark, sf_dir).singleton.skip().estimation.mean("c_acctbal").frame, [], se=4)


@query("allocate_proportional", "SELECT p_brand, count(*) AS size FROM part GROUP BY 1")
def allocate_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a rate of one, every group takes all of its rows."""
    sampling = Sample(read(spark, sf_dir, "part"), Design(stratum="p_brand")).sampling
    sizes = sampling.group_sizes()
    n = sampling.allocate(sizes, method="proportional", n_total=sum(sizes.values()))
    return spark.createDataFrame(list(n.items()), "p_brand string, size bigint")


@query("fill_forward", "SELECT o_orderkey, round(last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END IGNORE NULLS) OVER (ORDER BY o_orderkey), 6) AS d FROM orders")
def fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, "forward")


@query("fill_backward", "SELECT o_orderkey, round(last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END IGNORE NULLS) OVER (ORDER BY o_orderkey DESC), 6) AS d FROM orders")
def fill_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, "backward")


def _filled(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    some = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("d")
    s = Sample(read(spark, sf_dir, "orders").select("o_orderkey", some)).wrangling.order_by("o_orderkey")
    return rounded(s.wrangling.fill_null("d", strategy=how).data, ["o_orderkey"], d=6)


@query("pps_wr_counts", "SELECT p_brand, CAST(40 AS BIGINT) AS hits, CAST(sum(p_size) AS DOUBLE) AS size FROM part GROUP BY 1")
def pps_wr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All draws of a brand fall on its parts; a hit part's probability gives the brand's total size back."""
    s = Sample(read(spark, sf_dir, "part"), Design(stratum="p_brand", mos="p_size")).sampling.pps_wr(40, rstate=7)
    total = F.col("p_size") / (1 - F.pow(1 - F.col("survey_prob_selection"), F.lit(1 / 40)))
    return s.data.groupBy("p_brand").agg(F.sum("survey_number_of_hits").alias("hits"), F.round(F.max(total), 6).alias("size"))


@query("jackknife_median", """
WITH c AS (SELECT c_nationkey AS p, c_acctbal AS v, c_custkey % 5 + 1 AS w FROM customer),
r AS (SELECT DISTINCT p AS r FROM c UNION ALL SELECT -1),
x AS (SELECT r, v, sum(w) AS w FROM c, r WHERE p <> r GROUP BY r, v),
d AS (SELECT r, v, sum(w) OVER (PARTITION BY r ORDER BY v) / sum(w) OVER (PARTITION BY r) AS cdf FROM x),
t AS (SELECT r, min(v) AS q FROM d WHERE cdf >= 0.5 - 1e-12 GROUP BY r)
SELECT round((SELECT q FROM t WHERE r = -1), 6) AS est, round(sqrt(var_pop(q) * (count(*) - 1)), 6) AS se FROM t WHERE r >= 0""")
def jackknife_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of every replicate, all in one sort."""
    s = Sample(read(spark, sf_dir, "customer").withColumn("w", F.col("c_custkey") % 5 + 1), Design(psu="c_nationkey", wgt="w"))
    s = s.weighting.create_jk_wgts(as_array=True)
    return rounded(s.estimation.median("c_acctbal", method="replication").frame, [], est=6, se=6)
