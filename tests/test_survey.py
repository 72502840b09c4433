"""Invariants and small hand-made cases of the survey operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.design import BRRWeights, Design, JackknifeWeights, PopSize
from quadrat.errors import ColumnError, MethodError, MissingValueError, QuadratError, SingletonError
from quadrat.functions import dist
from quadrat.functions.expr import INDEX, coalesce, col, compute, concat_str, lit, struct, when
from quadrat.functions.terms import Cat, Cross
from quadrat.operators.size import SampleSize, calculate_power, power_for_two_proportions
from quadrat.operators.weighting import hadamard
from quadrat.sample import Sample, register_sample_accessor


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"s{i % 4}", i % 4 * 10 + (i // 4) % 5, float(1 + i % 3), float(rng.normal(10, 2)), float(rng.uniform(1, 5)), "AB"[i % 2], i % 2) for i in range(200)]
    return spark.createDataFrame(rows, "id long, stratum string, psu int, w double, y double, x double, g string, b int")


@pytest.fixture(scope="module")
def sample(frame):
    return Sample(frame, Design(stratum="stratum", psu="psu", wgt="w"))


def pandas_taylor(pdf, y, d=None):
    """Mean, standard error and degrees of freedom, straight from the definition."""
    d = np.ones(len(pdf)) if d is None else d
    w = pdf.w * d
    m = (w * pdf[y]).sum() / w.sum()
    z = (w * (pdf[y] - m) / w.sum()).groupby([pdf.stratum, pdf.psu]).sum()
    v = sum(len(g) / (len(g) - 1) * ((g - g.mean()) ** 2).sum() for _, g in z.groupby(level=0))
    live = (w > 0).groupby([pdf.stratum, pdf.psu]).any()
    df = sum(int(g.sum()) - 1 for _, g in live.groupby(level=0) if g.any())
    return m, math.sqrt(v), df


def test_mean_against_numpy(sample, frame):
    m, se, df = pandas_taylor(frame.toPandas(), "y")
    r = sample.estimation.mean("y").rows()[0]
    assert r["est"] == pytest.approx(m, rel=1e-12) and r["se"] == pytest.approx(se, rel=1e-10) and r["df"] == df
    assert r["lci"] == pytest.approx(m - dist.t_ppf(0.975, df) * se)


def test_where_keeps_the_design(sample, frame):
    pdf = frame.toPandas()
    m, se, df = pandas_taylor(pdf, "y", (pdf.psu % 10 < 2).astype(float))
    r = sample.estimation.mean("y", where=col("psu") % 10 < 2).rows()[0]
    assert (r["est"], r["se"], r["df"]) == (pytest.approx(m), pytest.approx(se), df)
    alone = sample.wrangling.filter_records(col("psu") % 10 < 2).estimation.mean("y").rows()[0]
    assert alone["est"] == pytest.approx(m) and alone["se"] != pytest.approx(se)


def test_by_equals_where(sample):
    by = {r["g"]: r for r in sample.estimation.mean("y", by="g").rows()}
    for g in "AB":
        one = sample.estimation.mean("y", where={"g": g}).rows()[0]
        assert by[g]["se"] == pytest.approx(one["se"]) and by[g]["df"] == one["df"]


def test_missing_values(sample, frame):
    s = sample.set_data(frame.withColumn("y", F.when(F.col("id") % 10 != 0, F.col("y")).otherwise(float("nan"))))
    with pytest.raises(MissingValueError):
        s.estimation.mean("y")
    r = s.estimation.mean("y", drop_nulls=True).rows()[0]
    same = sample.estimation.mean("y", where=col("id") % 10 != 0).rows()[0]
    assert r["se"] == pytest.approx(same["se"]) and r["n"] == 180


def test_proportions_and_intervals(sample):
    rows = sample.estimation.prop("g").rows()
    assert sum(r["est"] for r in rows) == pytest.approx(1)
    for how in ("logit", "beta", "korn-graubard", "wilson"):
        for r in sample.estimation.prop("g", ci_method=how).rows():
            assert 0 < r["lci"] < r["est"] < r["uci"] < 1


def test_quantile_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "y double")
    s = Sample(df, Design())
    q = lambda how, p=0.5: s.estimation.quantile("y", p=p, q_method=how).frame.first()["est"]
    assert (q("higher"), q("lower"), q("middle")) == (2.0, 1.0, 1.5)
    assert q("linear", 0.6) == pytest.approx(2.4) and q("nearest", 0.6) == 2.0


def test_jackknife_close_to_taylor(sample):
    t = sample.estimation.mean("y").rows()[0]
    j = sample.weighting.create_jk_wgts().estimation.mean("y", method="replication").rows()[0]
    assert j["est"] == pytest.approx(t["est"]) and j["se"] == pytest.approx(t["se"], rel=0.02) and j["df"] == t["df"]


def test_replicate_forms_agree(sample):
    a = sample.weighting.create_jk_wgts(as_array=True).estimation.corr(["y", "x"], method="replication").rows()[0]
    b = sample.weighting.create_jk_wgts().estimation.corr(["y", "x"], method="replication").rows()[0]
    assert a["se"] == pytest.approx(b["se"])


def test_coefficients():
    assert BRRWeights("r", 8, fay_coef=0.5).coefficients() == [1 / (8 * 0.25)] * 8
    assert JackknifeWeights("r", 10).coefficients()[0] == pytest.approx(0.9)
    for n in (2, 4, 12, 20, 28, 36, 44, 56):
        h = hadamard(n)
        assert len(h) == n and (h[0] == 1).all()
        assert (h @ h.T == len(h) * np.eye(len(h))).all()


def test_weighting_meets_controls(sample):
    ctrl = {f"s{k}": 100.0 * (k + 1) for k in range(4)}
    ps = sample.weighting.poststratify(ctrl, by="stratum")
    got = {r[0]: r[1] for r in ps.data.groupBy("stratum").agg(F.sum("ps_wgt")).collect()}
    assert got == {k: pytest.approx(v) for k, v in ctrl.items()}
    rk = sample.weighting.rake(controls={"stratum": ctrl, "g": {"A": 400.0, "B": 600.0}}, tol=1e-9, max_iter=500, strict=False)
    assert rk.data.agg(F.sum("rk_wgt")).first()[0] == pytest.approx(1000)
    cal = sample.weighting.calibrate(controls={Cat("g"): {"A": 300.0, "B": 700.0}, "x": 2500.0})
    r = cal.data.agg(F.sum("calib_wgt"), F.sum(F.col("calib_wgt") * F.col("x"))).first()
    assert r[0] == pytest.approx(1000) and r[1] == pytest.approx(2500)
    with pytest.raises(MethodError):
        sample.weighting.poststratify({"s0": 1.0}, by="stratum")


def test_trim_keeps_the_sum(sample):
    t = sample.weighting.trim(upper=2.5)
    r = t.data.agg(F.sum("trim_wgt"), F.max("trim_wgt"), F.sum("w")).first()
    assert r[0] == pytest.approx(r[2]) and r[1] <= 2.5 + 1e-9


def test_replicates_follow_adjustments(sample):
    s = sample.weighting.create_bs_wgts(5, rstate=1).weighting.normalize(100.0)
    sums = s.data.agg(*[F.sum(c) for c in ("norm_wgt", *[f"norm_wgt{k}" for k in range(1, 6)])]).first()
    assert all(v == pytest.approx(100) for v in sums) and s.design.rep_wgts.prefix == "norm_wgt"


def test_fpc_and_two_stages(frame):
    df = frame.withColumns({"N": F.lit(10), "M": F.lit(30)})
    base = Sample(df, Design(stratum="stratum", psu="psu", wgt="w")).estimation.mean("y").rows()[0]
    one = Sample(df, Design(stratum="stratum", psu="psu", wgt="w", pop_size=PopSize("N"))).estimation.mean("y").rows()[0]
    two = Sample(df, Design(stratum="stratum", psu="psu", ssu="id", wgt="w", pop_size=PopSize("N", "M"))).estimation.mean("y").rows()[0]
    assert one["se"] == pytest.approx(base["se"] * math.sqrt(0.5)) and two["se"] > one["se"]


def test_singletons(sample, frame):
    lone = sample.set_data(frame.withColumn("psu", F.when(F.col("stratum") == "s0", 0).otherwise(F.col("psu"))))
    assert lone.singleton.exists and lone.singleton.keys() == [("s0",)]
    with pytest.raises(SingletonError):
        lone.estimation.mean("y")
    est = [lone.singleton.handle(m).estimation.mean("y").rows()[0] for m in ("center", "collapse", "pool", "certainty", "scale")]
    assert len({round(r["est"], 9) for r in est}) == 1 and all(r["se"] > 0 for r in est[:2])
    assert lone.singleton.skip().estimation.mean("y").rows()[0]["n"] == 150


def test_tables_and_tests(sample):
    t = sample.categorical.tabulate("stratum", "g")
    assert sum(c["est"] for c in t.cells) == pytest.approx(1)
    assert t.is_crosstab and t.stats["df"] == 16
    counts = sample.categorical.tabulate("g", units="count")
    assert sum(c["est"] for c in counts.cells) == pytest.approx(sample.data.agg(F.sum("w")).first()[0])
    two = sample.categorical.ttest("y", group="g").rows[0]
    ols = sample.glm.fit("y", x="b").coefs[1]
    assert two["diff"] == pytest.approx(ols["est"]) and two["se"] == pytest.approx(ols["se"])
    assert 0 <= sample.categorical.ranktest("y", group="g").rows[0]["p_value"] <= 1
    assert sample.categorical.ranktest("y", group="stratum", score_fn=lambda r, n: r / n).rows[0]["ndf"] == 3


def test_models(sample):
    g = sample.glm.fit("b", x=["x", "y"], family="binomial")
    p = g.predict()
    w = p.agg(F.sum(F.col("w") * F.col("yhat")) / F.sum("w"), F.sum(F.col("w") * F.col("b")) / F.sum("w")).first()
    assert w[0] == pytest.approx(w[1], abs=1e-8)  # the score equation of the intercept
    m = g.margins(variables="x")[0]
    assert m["se"] > 0 and g.margins(at={"x": [1.0, 3.0]})[0]["kind"] == "margin"
    mixed = sample.glm.fit("y", x=["x", Cat("stratum"), Cross("x", Cat("g", ref="B"))])
    assert len(mixed.coefs) == 1 + 1 + 3 + 1
    pos = sample.glm.fit("y", x="x", family="gamma", link="log")
    assert pos.stats["iterations"] < 30


def test_selection(sample, frame):
    s = Sample(frame, Design(stratum="stratum", mos="x")).sampling
    for how in ("pps_sys", "pps_brewer", "pps_rs"):
        d = getattr(s, how)(3, rstate=2).data
        assert d.count() == 12
    again = [r["id"] for r in s.srs(4, rstate=9).data.orderBy("id").collect()]
    shuffled = Sample(frame.repartition(7), Design(stratum="stratum")).sampling.srs(4, rstate=9).data
    assert again == [r["id"] for r in shuffled.orderBy("id").collect()]
    kept = s.srs(2, where=col("b") == 1, rstate=1)
    assert kept.data.count() == 200 and kept.data.where("survey_number_of_hits > 0").count() == 4  # two strata hold the eligible rows
    assert s.allocate({"a": 10, "b": 30}, n_total=8) == {"a": 2, "b": 6}
    assert s.allocate({"a": 2, "b": 30}, n_total=20, method="equal", n_per_group=5) == {"a": 2, "b": 5}


def test_draws_with_replacement(spark, frame):
    s = Sample(frame, Design(stratum="stratum", mos="x"))
    got = s.sampling.pps_wr(30, rstate=3).data
    assert [r["h"] for r in got.groupBy("stratum").agg(F.sum("survey_number_of_hits").alias("h")).collect()] == [30] * 4
    assert got.where("stratum = 's1'").count() < 30 + 1
    again = Sample(frame.repartition(5), s.design).sampling.pps_wr(30, rstate=3).data
    key = lambda d: sorted((r["id"], r["survey_number_of_hits"], round(r["survey_prob_selection"], 9)) for r in d.collect())
    assert key(got) == key(again)
    rows = {r["id"]: r for r in frame.collect()}
    total = sum(r["x"] for r in rows.values() if r["stratum"] == "s2")
    for i, _, p in key(got):
        if rows[i]["stratum"] == "s2":
            assert p == pytest.approx(1 - (1 - rows[i]["x"] / total) ** 30)
    # one unit holds nearly all of the size, equal rows are units of their own
    odd = spark.createDataFrame([(1, 1e9), *[(2, 1.0)] * 50, (3, 5e8)], "id int, size double")
    hits = {r["id"]: r["h"] for r in Sample(odd, Design(mos="size")).sampling.pps_wr(3000, rstate=1).data.groupBy("id").agg(F.sum("survey_number_of_hits").alias("h")).collect()}
    assert sum(hits.values()) == 3000 and abs(hits[1] - 2000) < 130


def test_running_sums(spark):
    from quadrat.plans.prefix import running

    rows = [(None if i % 5 == 0 else i % 3, i * 7919 % 1000, float(i % 11) / 7) for i in range(400)]
    got = running(spark.createDataFrame(rows, "g int, o int, x double"), ["g"], [F.col("o"), F.col("x")], F.col("x"), "upto", before="before", total="total", row="row").collect()
    assert len({r["row"] for r in got}) == 400
    for g in {r["g"] for r in got}:
        one = sorted((r["o"], r["x"], r["upto"], r["before"], r["total"]) for r in got if r["g"] == g)
        assert [r[2] for r in one] == pytest.approx(np.cumsum([r[1] for r in one]).tolist())
        assert [r[3] for r in one] == [0.0, *[r[2] for r in one][:-1]]  # to the last bit
        assert {round(r[4], 9) for r in one} == {round(sum(r[1] for r in one), 9)}


def test_fill_from_neighbours(spark):
    values = [None, None, 3, None, 5, None, None, 8, None, *[None] * 20, 30, None]
    df = spark.createDataFrame([(i, v, "k") for i, v in enumerate(values)], "id int, v int, clash string").repartitionByRange(6, "id").sortWithinPartitions("id")
    w = Sample(df).wrangling
    for how, order in (("forward", values), ("backward", values[::-1])):
        want, last = [], None
        for v in order:
            last = v if v is not None else last
            want.append(last)
        out = w.fill_null("v", strategy=how).data
        assert [r["v"] for r in out.collect()] == (want if how == "forward" else want[::-1])
        assert out.columns == df.columns
    assert Sample(df.limit(0)).wrangling.fill_null("v", strategy="forward").data.count() == 0


def test_poisson_replicates_hang_on_rows(frame):
    twice = frame.union(frame.limit(20))
    key = lambda d: sorted(tuple(round(x, 9) for x in (r["id"], r["rep_wgt1"], r["rep_wgt2"], r["rep_wgt3"])) for r in d.collect())
    made = [key(Sample(d, Design(wgt="w")).weighting.create_bs_wgts(3, kind="poisson", rstate=5).data) for d in (twice, twice.repartition(5))]
    assert made[0] == made[1]


def test_replicate_quantiles_and_models(sample):
    s = sample.weighting.create_jk_wgts()
    pdf, rw = s.data.toPandas(), s.design.rep_wgts
    from quadrat.utils import weighted_quantiles

    columns = list(rw.columns)
    thetas = np.array([weighted_quantiles(pdf.y, pdf[c], [0.3])[0] for c in columns])
    got = s.estimation.quantile("y", p=0.3, method="replication").rows()[0]
    assert got["est"] == weighted_quantiles(pdf.y, pdf.w, [0.3])[0]
    assert got["var"] == pytest.approx((np.array(rw.coefficients()) * (thetas - thetas.mean()) ** 2).sum())
    by = s.estimation.quantile("y", p=0.5, by="g", method="replication", q_method="linear").rows()
    assert len(by) == 2 and all(r["se"] > 0 for r in by)

    fits = Sample(s.data, Design(wgt="w", rep_wgts=rw))  # nothing but replicates: their method
    X = np.column_stack([np.ones(len(pdf)), pdf.x])
    wls = lambda w: np.linalg.solve(X.T @ (X * w.to_numpy()[:, None]), X.T @ (w * pdf.y).to_numpy())
    T = np.array([wls(pdf[c]) for c in columns])
    want = (np.array(rw.coefficients())[:, None] * (T - T.mean(0)) ** 2).sum(0)
    assert [c["se"] ** 2 for c in fits.glm.fit("y", x="x").coefs] == pytest.approx(want.tolist())
    for family, y in (("binomial", "b"), ("poisson", "b")):
        assert all(c["se"] > 0 for c in fits.glm.fit(y, x="x", family=family).coefs)


def test_wrangling(sample, frame):
    w = sample.wrangling
    out = w.mutate({"c": col("a") + 1, "a": col("y") * 2}).data.where("abs(c - y * 2 - 1) > 1e-9")
    assert out.count() == 0
    with pytest.raises(MethodError):
        w.mutate({"a": col("b2"), "b2": col("a")})
    with pytest.raises(ColumnError):
        w.remove_columns("w")
    renamed = w.rename_columns({"w": "weight", "psu": "cluster"})
    assert renamed.design.wgt == "weight" and renamed.design.psu == "cluster"
    assert w.with_row_index().data.agg(F.max("row_index")).first()[0] == 199
    assert w.distinct("g", keep="none").data.count() == 0
    assert w.cast({"b": "string"}).dtypes["b"] == "string"
    with pytest.raises(MethodError):
        w.cast({"y": "int"})
    odd = Sample(frame.withColumnRenamed("y", "My Value (x)")).wrangling.clean_names()
    assert "my_value_x" in odd.data.columns


def test_expressions(spark):
    df = spark.createDataFrame([(1, "ab c", [3, None, 1], 4.0), (2, None, [], -1.0), (3, "xyz", None, None)], "i int, s string, l array<int>, v double")
    out = compute(
        df,
        {
            "a": col("s").replace("b", "Z"),
            "p": col("s").pad_left(6, "*"),
            "t": col("s").slice(-2),
            "m": col("l").list_mean(),
            "n": (col("v") / 0),
            "lg": col("v").log(),
            "w": when(col("v") > 0).then(lit("pos")).otherwise("neg"),
            "c": concat_str("s", lit("!")),
            "z": coalesce("v", lit(0.0)),
            "k": col("v").sum(),
            "st": struct(a="i", b="v"),
            "cs": col("v").fill_null(0.0).cum_sum(),
            "sh": col("i").shift(1, 0),
            "ro": col("i").rolling_sum(2),
            "e": col("i").ewm_mean(alpha=0.5),
        },
    )
    r = {x["i"]: x for x in out.collect()}
    assert r[1]["a"] == "aZ c" and r[1]["p"] == "**ab c" and r[1]["t"] == " c" and r[1]["m"] == 2.0
    assert r[1]["n"] == math.inf and r[2]["n"] == -math.inf and math.isnan(r[2]["lg"]) and r[3]["lg"] is None
    assert r[2]["c"] is None and r[3]["z"] == 0.0 and r[1]["k"] == 3.0 and r[3]["st"]["a"] == 3
    assert [r[k]["cs"] for k in (1, 2, 3)] == [4.0, 3.0, 3.0] and [r[k]["sh"] for k in (1, 2, 3)] == [0, 1, 2]
    assert [r[k]["ro"] for k in (1, 2, 3)] == [None, 3, 5] and r[2]["e"] == pytest.approx((1 * 0.5 + 2) / 1.5)
    assert INDEX not in out.columns
    with pytest.raises(TypeError):
        bool(col("i") > 1)


def test_distributions():
    for df in (1, 2.5, 30, 297):
        for p in (0.01, 0.3, 0.5, 0.975):
            assert dist.t_cdf(dist.t_ppf(p, df), df) == pytest.approx(p, abs=1e-10)
            assert dist.chi2_cdf(dist.chi2_ppf(p, df), df) == pytest.approx(p, abs=1e-10)
            assert dist.f_cdf(dist.f_ppf(p, 3, df), 3, df) == pytest.approx(p, abs=1e-9)
            assert dist.beta_cdf(dist.beta_ppf(p, 2, df), 2, df) == pytest.approx(p, abs=1e-10)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385)


def test_sizes_and_power():
    assert SampleSize().estimate_prop(0.5, 0.05).size["n"] == 385
    assert SampleSize().estimate_mean(10, 1).size["n"] == 385
    assert SampleSize().estimate_prop({"a": 0.5, "b": 0.1}, 0.05).rows()[1]["stratum"] == "b"
    assert SampleSize().compare_means(1, 2, 3).size["n1_0"] == 142
    assert calculate_power(0.0) == pytest.approx(0.05) and calculate_power([0.0, 9.0])[1] == pytest.approx(1.0)
    assert 0 < power_for_two_proportions(0.3, 0.4, 100) < 1
    with pytest.raises(QuadratError):
        SampleSize().compare_means(1, 1, 3)


def test_labels_and_accessors(sample):
    s = sample.set_var_label("g", "Group").set_value_labels("g", {"A": "First", "B": "Second"})
    assert s.labels == {"g": "Group"} and sample.labels == {}
    assert s.estimation.mean("y", by="g").use_labels(s)[0]["g_label"] == "First"

    @register_sample_accessor("sizes")
    class Sizes:
        def __init__(self, sample):
            self.n = sample.n_records

    assert s.sizes.n == 200 and s.deff_w > 1 and s.n_strata == 4 and s.n_psus == 20


def test_table_views(sample):
    t = sample.categorical.tabulate("stratum", "g")
    s = sample.set_value_labels("g", {"A": "First", "B": "Second"})
    assert {c["col"] for c in t.use_labels(s).cells} == {"First", "Second"}
    full = t.fill_missing()
    assert len(full.cells) == 8 and full.crosstab()["s0"].keys() == {"A", "B"}
    assert t.set_stats(note=1).stats["note"] == 1 and t.style(2)[0]["est"] == round(t.cells[0]["est"], 2)


def test_utilities(frame):
    from quadrat import utils

    odd = frame.withColumn("y", F.when(F.col("id") > 3, F.col("y")).otherwise(float("nan")))
    assert utils.drop_missing(odd, ["y"]).count() == 196
    with pytest.raises(MissingValueError, match="y: 4"):
        utils.assert_no_missing(odd, ["y", "x"])
    assert utils.weighted_quantiles([3, 1, 2], [1, 1, 2], [0.25, 0.5, 1.0]).tolist() == [1.0, 2.0, 3.0]
    assert utils.weighted_quantile_bins([1, 2, 3, 4], [1, 1, 1, 1], 2).tolist() == [1.0, 2.0, 4.0]
    assert utils.seed_from_random_state(5) == 5 and len(utils.spawn_child_rngs(1, 3)) == 3
    with utils.temporary_log_level("DEBUG") as log:
        assert log.level == 10
