"""Means, totals, ratios, proportions, quantiles, covariances and correlations."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.design import names
from quadrat.errors import MethodError, MissingValueError
from quadrat.functions import dist
from quadrat.plans.prefix import running
from quadrat.plans.units import Frame, equal, grouped, root, unit_sums, variances
from quadrat.plans.where import missing, predicate

CI_METHODS = {"logit": "logit", "beta": "beta", "clopper-pearson": "beta", "korn-graubard": "korn-graubard", "kg": "korn-graubard", "wilson": "wilson", "score": "wilson"}
Q_METHODS = ("lower", "higher", "middle", "nearest", "linear")
#: Replicate sums computed in one aggregation; more make generated code too large.
CHUNK = 100


@dataclass
class Prepared:
    """Rows with ``__w`` (weight) and ``__d`` (in the domain); design keys beside."""

    frame: Frame
    bad: Column | None = None  # rows that must not be there, to be counted with the sums


@dataclass
class Estimate:
    """Estimates as a small DataFrame, a row per domain and item.

    ``frame`` is lazy and has est, se, var, df, n and what was asked for besides;
    the other methods run it once and add intervals.
    """

    param: str
    method: str
    frame: DataFrame
    by: list[str] = field(default_factory=list)
    alpha: float = 0.05
    ci: str = "t"
    meta: object = None
    decimals: int | None = None
    _rows: list[dict] | None = None

    def rows(self) -> list[dict]:
        """All estimates with cv, lci and uci, ordered by domain and item."""
        if self._rows is None:
            found = [r.asDict() for r in self.frame.collect()]
            found.sort(key=lambda r: [(r[b] is None, str(type(r[b])), r[b]) for b in self.by] + [str(r.get("y")), r.get("p") or 0.0, str(r.get("y_level"))])
            self._rows = [r | interval(r, self.alpha, self.ci) for r in found]
        return self._rows

    to_dicts = rows

    def to_df(self) -> DataFrame:
        import pandas as pd

        rows = self.rows()
        return self.frame.sparkSession.createDataFrame(pd.DataFrame(rows)) if rows else self.frame

    def style(self, decimals: int) -> Estimate:
        return Estimate(self.param, self.method, self.frame, self.by, self.alpha, self.ci, self.meta, decimals, self._rows)

    def use_labels(self, sample) -> list[dict]:
        """Rows with the labels of the domain values beside them."""
        out = []
        for r in self.rows():
            out.append(r | {f"{b}_label": sample.resolve_labels(b).get(r[b], r[b]) for b in self.by})
        return out

    def __str__(self) -> str:
        rows = self.rows()
        cols = [c for c in (rows[0] if rows else {}) if c not in ("df", "var")]
        show = lambda v: f"{v:.{self.decimals if self.decimals is not None else 4}f}" if isinstance(v, float) else str(v)
        table = [cols, *[[show(r[c]) for c in cols] for r in rows]]
        width = [max(len(t[k]) for t in table) for k in range(len(cols))]
        return "\n".join([f"{self.param} ({self.method})", *["  ".join(x.rjust(w) for x, w in zip(t, width)) for t in table]])


def interval(r: dict, alpha: float, kind: str) -> dict:
    """cv, lci and uci of one estimate."""
    est, se, df = r.get("est"), r.get("se"), r.get("df")
    nan = math.nan
    if est is None or se is None or math.isnan(se):
        return {"cv": nan, "lci": nan, "uci": nan}
    cv = math.inf if est == 0 else se / est
    if not df or df <= 0:
        return {"cv": cv, "lci": nan, "uci": nan}
    t = dist.t_ppf(1 - alpha / 2, df)
    lo, hi = est - t * se, est + t * se
    if kind in ("logit", "beta", "korn-graubard", "wilson"):
        lo, hi = proportion_interval(est, se, df, r.get("n") or 0, t, alpha, kind)
    elif kind == "fisher" and abs(est) < 1:
        z, sz = math.atanh(est), se / (1 - est * est)
        lo, hi = math.tanh(z - t * sz), math.tanh(z + t * sz)
    elif kind == "woodruff":
        lo, hi = r["lci"], r["uci"]
    return {"cv": cv, "lci": lo, "uci": hi}


def proportion_interval(p: float, se: float, df: float, n: float, t: float, alpha: float, kind: str) -> tuple[float, float]:
    edge = p <= 0 or p >= 1
    if kind == "logit":
        if edge:
            return p, p
        z, s = math.log(p / (1 - p)), t * se / (p * (1 - p))
        return 1 / (1 + math.exp(-(z - s))), 1 / (1 + math.exp(-(z + s)))
    if edge and kind != "korn-graubard":
        return p, p
    ratio = (dist.t_ppf(1 - alpha / 2, n - 1) / t) ** 2 if n > 1 else 1.0
    size = n * ratio if edge or se == 0 else p * (1 - p) / se**2 * ratio
    if kind == "korn-graubard":
        size = min(size, n)
    if kind == "wilson":
        z = dist.norm_ppf(1 - alpha / 2)
        mid, half = p + z * z / (2 * size), z * math.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
        return (mid - half) / (1 + z * z / size), (mid + half) / (1 + z * z / size)
    x = p * size
    lo = 0.0 if x <= 0 else dist.beta_ppf(alpha / 2, x, size - x + 1)
    hi = 1.0 if x >= size else dist.beta_ppf(1 - alpha / 2, x + 1, size - x)
    return lo, hi


def listed(y) -> list:
    return [y] if isinstance(y, (str, tuple)) else list(y)


def _pack(df: DataFrame, keys: list[str], items: list[tuple[dict, dict]]) -> DataFrame:
    """One row per item from a wide row: each item has constant and computed fields."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], *[c.alias(k) for k, c in computed.items()]) for fixed, computed in items]
    return df.select(*keys, F.explode(F.array(*structs)).alias("__x")).select(*keys, "__x.*")


class Estimation:
    def __init__(self, sample):
        self.sample = sample

    # ---- preparation -------------------------------------------------------
    def _prepare(self, relevant: list[str], by, where, drop_nulls: bool, deferred: bool = False) -> Prepared:
        s, d = self.sample, self.sample.design
        df, types = s.data, dict(s.data.dtypes)
        by = list(names(by))
        p = predicate(where)
        domain = F.coalesce(p, F.lit(False)) if p is not None else F.lit(True)
        weight = F.col(d.wgt).cast("double") if d.wgt else F.lit(1.0)
        state = s._singleton
        strata, psus = list(state.get("strata", d.strata)), list(state.get("psus", d.psus))
        fixed = [c for c in dict.fromkeys([*([d.wgt] if d.wgt else []), *strata, *psus])]
        bad_design = [missing(F.col(c), types.get(c, "string")) for c in fixed if c in types]
        bad_values = [missing(F.col(c), types[c]) for c in dict.fromkeys([*relevant, *by])]
        anybad = lambda cs: F.lit(False) if not cs else _any(cs)
        if drop_nulls:
            if bad_design:
                df = df.where(~anybad(bad_design))
        bad = None if drop_nulls else anybad([*bad_design, *bad_values])
        if state.get("skip"):
            df = df.where(~F.col(state["skip"]))
        valid = domain & ~anybad([missing(F.col(c), types[c]) for c in by])
        df = df.withColumns({"__d": valid, "__w": weight})
        frame = Frame(df, by, strata, psus, list(d.ssus), d.pop_size.psu if d.pop_size and not d.wr else None, d.pop_size.ssu if d.pop_size and not d.wr else None, state.get("method"), state.get("lone"))
        prep = Prepared(frame, bad)
        if bad is not None and not deferred:
            # a pass over the relevant columns; nothing else is looked at
            self._missing(df.where(bad).limit(1).count())
        return prep

    @staticmethod
    def _missing(n: int | None) -> None:
        if n:
            raise MissingValueError("missing values in the columns that the estimate uses", where="estimation", hint="drop_nulls=True")

    def _method(self, method: str | None) -> str:
        d = self.sample.design
        method = method or d.method
        if method not in ("taylor", "replication"):
            raise MethodError("method must be taylor or replication", param="method")
        if method == "replication" and not d.rep_wgts:
            raise MethodError("the design has no replicate weights", where="estimation", hint="create them with sample.weighting")
        return method

    def _valid(self, cols: list[str]) -> Column:
        types = dict(self.sample.data.dtypes)
        return F.col("__d") & ~_any([missing(F.col(c), types[c]) for c in cols]) if cols else F.col("__d")

    # ---- linearization -----------------------------------------------------
    def _linear(self, prep: Prepared, items: list[dict], deff: str | None, kind: str) -> DataFrame:
        """Items have ``fixed`` fields, numerator ``y`` and denominator ``x`` columns and validity ``ok``."""
        sums: dict[str, Column] = {}
        for j, it in enumerate(items):
            w = F.when(it["ok"], F.col("__w")).otherwise(0.0)
            y = F.when(it["ok"], it["y"].cast("double")).otherwise(0.0)
            x = F.when(it["ok"], it["x"].cast("double")).otherwise(0.0)
            sums |= {f"w{j}": w, f"y{j}": w * y, f"x{j}": w * x, f"n{j}": (w > 0).cast("long")}
            if deff:
                sums |= {f"yy{j}": w * y * y, f"xx{j}": w * x * x, f"xy{j}": w * x * y}
        if prep.bad is not None:
            sums["bad"] = prep.bad.cast("long")
        units = unit_sums(prep.frame, sums)
        if prep.frame.psus:
            # a row per PSU: checks, totals and variances all read it, the microdata once
            units = units.persist()
        if prep.bad is not None:
            self._missing(units.agg(F.sum("bad")).first()[0])
            del sums["bad"]
        totals = grouped(units, prep.frame.by, [F.sum(c).alias(f"t_{c}") for c in sums])
        scores, active = {}, {}
        for j, _ in enumerate(items):
            if kind == "total":
                scores[f"i{j}"] = lambda j=j: F.col(f"y{j}")
            else:
                scores[f"i{j}"] = lambda j=j: F.when(F.col(f"t_x{j}") != 0, (F.col(f"y{j}") - F.col(f"t_y{j}") / F.col(f"t_x{j}") * F.col(f"x{j}")) / F.col(f"t_x{j}"))
            active[f"i{j}"] = f"n{j}"
        if prep.frame.singleton == "scale":
            # variances come from the other strata alone, their own totals included
            f = prep.frame
            rest = Frame(f.data.where(~F.col(self.sample._singleton["flag"])), f.by, f.strata, f.psus, f.ssus, f.fpc_psu, f.fpc_ssu, f.singleton)
            others = unit_sums(rest, sums)
            var = variances(others, rest, grouped(others, f.by, [F.sum(c).alias(f"t_{c}") for c in sums]), scores, active)
        else:
            var = variances(units, prep.frame, totals, scores, active)
        full = equal(var, totals, prep.frame.by)
        scale = self.sample._singleton.get("fraction")
        out = []
        for j, it in enumerate(items):
            t = lambda c, j=j: F.col(f"t_{c}{j}")
            est = t("y") if kind == "total" else F.try_divide(t("y"), t("x"))
            v = F.col(f"var_i{j}")
            if prep.frame.singleton == "scale" and scale is not None:
                v = v * (1 / (1 - scale) if kind == "total" else (1 - scale))
            computed = {"est": est, "se": F.sqrt(F.coalesce(v, F.lit(0.0))), "var": v, "df": F.col(f"df_i{j}"), "n": t("n"), "n_psus": F.col(f"psus_i{j}"), "n_strata": F.col(f"strata_i{j}")}
            if deff:
                computed["deff"] = _deff(kind, t, est, v, deff)
            out.append((it["fixed"], computed))
        found = _pack(full, prep.frame.by, out)
        return found.where(F.col("n") > 0) if prep.frame.by else found

    def _point(self, param: str, kind: str, items_of, relevant, by, where, method, deff, fay, center, alpha, drop_nulls, ci="t") -> Estimate:
        method = self._method(method)
        deff = {True: "wor", False: None}.get(deff, deff) if isinstance(deff, bool) else deff
        prep = self._prepare(relevant, by, where, drop_nulls, deferred=method == "taylor")
        items = items_of(prep)
        if method == "taylor":
            frame = self._linear(prep, items, deff, kind)
        else:
            frame = self._replicated(prep, items, kind, fay, center)
        return Estimate(param, method, frame, prep.frame.by, alpha, ci, self.sample.meta)

    # ---- replication -------------------------------------------------------
    def _rep_weight(self, r: int) -> Column:
        rw = self.sample.design.rep_wgts
        c = F.col(rw.array)[r - 1] if rw.array else F.col(rw.columns[r - 1])
        return F.coalesce(c.cast("double"), F.lit(0.0))

    def _rep_sums(self, prep: Prepared, sums: dict[str, Column]) -> DataFrame:
        """Per domain: each sum under the main weight (``<name>``) and under the replicates (array ``r_<name>``).

        ``sums`` are columns without a weight.  Replicates go in chunks of
        aggregates; the chunks are joined by domain.
        """
        rw, frame = self.sample.design.rep_wgts, prep.frame
        ids = list(range(1, rw.n_reps + 1))
        parts = None
        for at in range(0, len(ids), CHUNK):
            some = ids[at : at + CHUNK]
            aggs = []
            if at == 0:
                aggs += [F.sum(F.col("__w") * c).alias(k) for k, c in sums.items()] + [F.count_if(F.col("__d") & (F.col("__w") > 0)).alias("n")]
            aggs += [F.array(*[F.sum(self._rep_weight(r) * c) for r in some]).alias(f"r{at}_{k}") for k, c in sums.items()]
            part = grouped(frame.data.where("__d") if not frame.by else frame.data, frame.by, aggs)
            parts = part if parts is None else equal(parts, part, frame.by)
        starts = range(0, len(ids), CHUNK)
        return parts.select(*frame.by, "n", *sums, *[F.concat(*[F.col(f"r{a}_{k}") for a in starts]).alias(f"r_{k}") for k in sums])

    def _rep_var(self, theta: Column, est: Column, fay: float, center: str) -> Column:
        rw = self.sample.design.rep_wgts
        coef = F.array(*[F.lit(float(c)) for c in rw.coefficients(fay)])
        if center not in ("rep_mean", "estimate", "full_sample"):
            raise MethodError("variance_center must be rep_mean or estimate", param="variance_center")
        mid = F.aggregate(theta, F.lit(0.0), lambda a, x: a + x) / F.lit(float(rw.n_reps)) if center == "rep_mean" else est
        return F.aggregate(F.zip_with(theta, coef, lambda t, c: F.struct(t.alias("t"), c.alias("c"))), F.lit(0.0), lambda a, x: a + x["c"] * F.pow(x["t"] - mid, 2))

    def _replicated(self, prep: Prepared, items: list[dict], kind: str, fay: float, center: str) -> DataFrame:
        sums = {}
        for j, it in enumerate(items):
            ok = it["ok"]
            sums |= {f"y{j}": F.when(ok, it["y"].cast("double")).otherwise(0.0), f"x{j}": F.when(ok, it["x"].cast("double")).otherwise(0.0), f"c{j}": ok.cast("double")}
        got = self._rep_sums(prep, sums)
        wide = {}
        for j, _ in enumerate(items):
            wide[f"est{j}"] = F.col(f"y{j}") if kind == "total" else F.try_divide(F.col(f"y{j}"), F.col(f"x{j}"))
            wide[f"theta{j}"] = F.col(f"r_y{j}") if kind == "total" else F.zip_with(f"r_y{j}", f"r_x{j}", F.try_divide)
        got = got.withColumns(wide)
        df = F.lit(self.sample.design.rep_wgts.degrees()).cast("long")
        out = []
        for j, it in enumerate(items):
            v = self._rep_var(F.col(f"theta{j}"), F.col(f"est{j}"), fay, center)
            out.append((it["fixed"], {"est": F.col(f"est{j}"), "se": F.sqrt(v), "var": v, "df": df, "n": F.col("n")}))
        found = _pack(got, prep.frame.by, out)
        return found.where(F.col("n") > 0) if prep.frame.by else found

    # ---- parameters --------------------------------------------------------
    def mean(self, y, *, by=None, where=None, method=None, deff=None, fay_coef=0.0, as_factor=False, variance_center="rep_mean", alpha=0.05, drop_nulls=False) -> Estimate:
        if as_factor:
            return self.prop(y, by=by, where=where, method=method, deff=deff, fay_coef=fay_coef, variance_center=variance_center, alpha=alpha, drop_nulls=drop_nulls)
        ys = listed(y)
        items = lambda p: [{"fixed": {"y": c}, "y": F.col(c), "x": F.lit(1.0), "ok": self._valid([c])} for c in ys]
        return self._point("mean", "mean", items, ys, by, where, method, deff, fay_coef, variance_center, alpha, drop_nulls)

    def total(self, y, *, by=None, where=None, method=None, deff=None, fay_coef=0.0, as_factor=False, variance_center="rep_mean", alpha=0.05, drop_nulls=False) -> Estimate:
        ys = listed(y)
        if as_factor:
            items = lambda p: self._levels(p, ys)
        else:
            items = lambda p: [{"fixed": {"y": c}, "y": F.col(c), "x": F.lit(1.0), "ok": self._valid([c])} for c in ys]
        return self._point("total", "total", items, ys, by, where, method, deff, fay_coef, variance_center, alpha, drop_nulls)

    def ratio(self, y, x, *, by=None, where=None, method=None, deff=None, fay_coef=0.0, variance_center="rep_mean", alpha=0.05, drop_nulls=False) -> Estimate:
        ys, xs = listed(y), listed(x)
        if len(ys) != len(xs) and 1 not in (len(ys), len(xs)):
            raise MethodError("y and x must pair up, or one of them be single", where="ratio")
        n = max(len(ys), len(xs))
        pairs = list(zip(ys * n if len(ys) == 1 else ys, xs * n if len(xs) == 1 else xs))
        items = lambda p: [{"fixed": {"y": a, "x": b}, "y": F.col(a), "x": F.col(b), "ok": self._valid([a, b])} for a, b in pairs]
        return self._point("ratio", "ratio", items, [*ys, *xs], by, where, method, deff, fay_coef, variance_center, alpha, drop_nulls)

    def _levels(self, prep: Prepared, ys: list[str]) -> list[dict]:
        """An item per level of each variable; levels are those of the domain, as strings in order."""
        out = []
        for c in ys:
            found = prep.frame.data.where(self._valid([c])).select(F.col(c).cast("string").alias("v")).distinct().collect()
            for v in sorted(r["v"] for r in found):
                hit = (F.col(c).cast("string") == v).cast("double")
                out.append({"fixed": {"y": c, "y_level": v}, "y": hit, "x": F.lit(1.0), "ok": self._valid([c])})
        return out

    def prop(self, y, *, by=None, where=None, method=None, ci_method="logit", deff=None, fay_coef=0.0, variance_center="rep_mean", alpha=0.05, drop_nulls=False) -> Estimate:
        if ci_method not in CI_METHODS:
            raise MethodError(f"no such interval: {ci_method}", param="ci_method")
        ys = listed(y)
        return self._point("prop", "mean", lambda p: self._levels(p, ys), ys, by, where, method, deff, fay_coef, variance_center, alpha, drop_nulls, CI_METHODS[ci_method])

    def corr(self, cols, *, kind="pearson", by=None, where=None, method=None, ci_method="fisher", deff=None, fay_coef=0.0, variance_center="rep_mean", alpha=0.05, drop_nulls=False) -> Estimate:
        if kind != "pearson":
            raise MethodError("only pearson correlations", param="kind")
        return self._association("corr", cols, by, where, method, fay_coef, variance_center, alpha, drop_nulls, "fisher" if ci_method == "fisher" else "t", deff)

    def cov(self, cols, *, by=None, where=None, method=None, deff=None, fay_coef=0.0, variance_center="rep_mean", alpha=0.05, drop_nulls=False) -> Estimate:
        return self._association("cov", cols, by, where, method, fay_coef, variance_center, alpha, drop_nulls, "t", deff)

    def _association(self, param, cols, by, where, method, fay, center, alpha, drop_nulls, ci, deff) -> Estimate:
        cols = listed(cols)
        pairs = [tuple(c) for c in cols] if isinstance(cols[0], tuple) else [(a, b) for k, a in enumerate(cols) for b in cols[k + 1 :]] or [(cols[0], cols[0])]
        used = list(dict.fromkeys(c for p in pairs for c in p))
        method = self._method(method)
        prep = self._prepare(used, by, where, drop_nulls)
        frame = prep.frame
        ok = {p: self._valid(list(p)) for p in pairs}
        # the means first, so that second moments are taken about them
        first = {}
        for j, (a, b) in enumerate(pairs):
            w = F.when(ok[a, b], F.col("__w")).otherwise(0.0)
            first |= {f"mw{j}": w, f"ma{j}": w * F.when(ok[a, b], F.col(a)).otherwise(0.0), f"mb{j}": w * F.when(ok[a, b], F.col(b)).otherwise(0.0), f"mn{j}": (w > 0).cast("long")}
        means = grouped(frame.data, frame.by, [F.sum(c).alias(k) for k, c in first.items()])
        data = equal(frame.data, means, frame.by)
        centred = {}
        for j, (a, b) in enumerate(pairs):
            centred[f"ca{j}"] = F.when(ok[a, b] & (F.col(f"mw{j}") > 0), F.col(a) - F.try_divide(F.col(f"ma{j}"), F.col(f"mw{j}"))).otherwise(0.0)
            centred[f"cb{j}"] = F.when(ok[a, b] & (F.col(f"mw{j}") > 0), F.col(b) - F.try_divide(F.col(f"mb{j}"), F.col(f"mw{j}"))).otherwise(0.0)
        data = data.withColumns(centred)
        prep.frame.data = data
        sums = {}
        for j, (a, b) in enumerate(pairs):
            one = ok[a, b].cast("double")
            ca, cb = F.col(f"ca{j}"), F.col(f"cb{j}")
            sums |= {f"w{j}": one, f"a{j}": one * ca, f"b{j}": one * cb, f"aa{j}": one * ca * ca, f"bb{j}": one * cb * cb, f"ab{j}": one * ca * cb}

        def value(ab: Column, aa: Column, bb: Column, n: Column) -> Column:
            if param == "corr":
                return F.try_divide(ab, F.sqrt(aa * bb))
            return ab * F.try_divide(n, n - 1)

        if method == "replication":
            got = self._rep_sums(prep, sums)
            wide, out = {}, []
            for j, _ in enumerate(pairs):
                moment = lambda x, a, b, w: F.try_divide(x, w) - F.try_divide(a, w) * F.try_divide(b, w)
                c = {k: F.col(f"{k}{j}") for k in ("w", "a", "b", "aa", "bb", "ab")}
                wide[f"est{j}"] = value(moment(c["ab"], c["a"], c["b"], c["w"]), moment(c["aa"], c["a"], c["a"], c["w"]), moment(c["bb"], c["b"], c["b"], c["w"]), F.col("n"))
                z = F.arrays_zip(*[F.col(f"r_{k}{j}").alias(k) for k in c])
                wide[f"theta{j}"] = F.transform(z, lambda x: value(moment(x["ab"], x["a"], x["b"], x["w"]), moment(x["aa"], x["a"], x["a"], x["w"]), moment(x["bb"], x["b"], x["b"], x["w"]), F.col("n")))
            got = got.withColumns(wide)
            for j, (a, b) in enumerate(pairs):
                v = self._rep_var(F.col(f"theta{j}"), F.col(f"est{j}"), fay, center)
                out.append(({"y": a, "x": b}, {"est": F.col(f"est{j}"), "se": F.sqrt(v), "var": v, "df": F.lit(self.sample.design.rep_wgts.degrees()).cast("long"), "n": F.col("n")}))
            found = _pack(got, frame.by, out)
        else:
            weighted = {k: F.col("__w") * c for k, c in sums.items()} | {f"n{j}": ((F.col("__w") > 0) & ok[p]).cast("long") for j, p in enumerate(pairs)}
            units = unit_sums(frame, weighted)
            totals = grouped(units, frame.by, [F.sum(c).alias(f"t_{c}") for c in weighted])
            scores, active = {}, {}
            for j, _ in enumerate(pairs):
                t = lambda c, j=j: F.col(f"t_{c}{j}")
                u = lambda c, j=j: F.col(f"{c}{j}")
                if param == "cov":
                    scores[f"i{j}"] = lambda t=t, u=u: F.try_divide(u("ab") - F.try_divide(t("ab"), t("w")) * u("w"), t("w")) * F.try_divide(t("n"), t("n") - 1)
                else:
                    # standardised products: ab/(sa sb) - rho/2 (aa/sa^2 + bb/sb^2)
                    def rho_score(t=t, u=u):
                        va, vb = F.try_divide(t("aa"), t("w")), F.try_divide(t("bb"), t("w"))
                        rho = F.try_divide(t("ab"), F.sqrt(t("aa") * t("bb")))
                        return F.try_divide(F.try_divide(u("ab"), F.sqrt(va * vb)) - rho / 2 * (F.try_divide(u("aa"), va) + F.try_divide(u("bb"), vb)), t("w"))

                    scores[f"i{j}"] = rho_score
                active[f"i{j}"] = f"n{j}"
            var = equal(variances(units, frame, totals, scores, active), totals, frame.by)
            out = []
            for j, (a, b) in enumerate(pairs):
                t = lambda c, j=j: F.col(f"t_{c}{j}")
                est = value(F.try_divide(t("ab"), t("w")), F.try_divide(t("aa"), t("w")), F.try_divide(t("bb"), t("w")), t("n"))
                v = F.col(f"var_i{j}")
                computed = {"est": est, "se": F.sqrt(v), "var": v, "df": F.col(f"df_i{j}"), "n": t("n")}
                if deff:
                    base = F.pow(1 - est * est, 2) / t("n") if param == "corr" else (F.try_divide(t("aa"), t("w")) * F.try_divide(t("bb"), t("w")) + est * est) / t("n")
                    computed["deff"] = F.try_divide(v, base)
                out.append(({"y": a, "x": b}, computed))
            found = _pack(var, frame.by, out)
        return Estimate(param, method, found.where(F.col("n") > 0) if frame.by else found, frame.by, alpha, ci, self.sample.meta)

    def median(self, y, *, by=None, where=None, method=None, fay_coef=0.0, q_method="higher", variance_center="rep_mean", alpha=0.05, drop_nulls=False) -> Estimate:
        out = self.quantile(y, p=(0.5,), by=by, where=where, method=method, fay_coef=fay_coef, q_method=q_method, variance_center=variance_center, alpha=alpha, drop_nulls=drop_nulls)
        out.param = "median"
        return out

    def quantile(self, y, *, p=(0.25, 0.5, 0.75), by=None, where=None, method=None, fay_coef=0.0, q_method="higher", variance_center="rep_mean", alpha=0.05, drop_nulls=False) -> Estimate:
        """Weighted quantiles; linearization gives Woodruff's interval, replication a t interval."""
        if q_method not in Q_METHODS:
            raise MethodError(f"q_method must be one of {', '.join(Q_METHODS)}", param="q_method")
        ps = [float(x) for x in ([p] if isinstance(p, (int, float)) else p)]
        if any(not 0 < x < 1 for x in ps):
            raise MethodError("p must lie between 0 and 1", param="p")
        ys = listed(y)
        method = self._method(method)
        prep = self._prepare(ys, by, where, drop_nulls)
        found = None
        for c in ys:
            part = self._quantile_taylor(prep, c, ps, q_method, alpha) if method == "taylor" else self._quantile_rep(prep, c, ps, q_method, fay_coef, variance_center)
            found = part if found is None else found.unionByName(part)
        return Estimate("quantile", method, found, prep.frame.by, alpha, "woodruff" if method == "taylor" else "t", self.sample.meta)

    def _cdf(self, prep: Prepared, y: str, weight: Column, q_method: str) -> DataFrame:
        """(by, v, cdf, total): values in order with cumulative shares of the weight."""
        by = prep.frame.by
        rows = prep.frame.data.where(self._valid([y])).select(*by, F.col(y).cast("double").alias("v"), weight.alias("w")).where("w > 0")
        return _cumulated(rows, by, q_method)

    @staticmethod
    def _invert(p: Column | float, q_method: str) -> tuple[Column, Column]:
        """Aggregates (left, right) bracketing p: structs of (cdf, v)."""
        p = F.lit(p) if isinstance(p, float) else p
        eps = 1e-12
        at = F.struct("cdf", "v")
        return F.max(F.when(F.col("cdf") < p - eps, at)), F.min(F.when(F.col("cdf") >= p - eps, at))

    @staticmethod
    def _between(left: Column, right: Column, p: Column, q_method: str) -> Column:
        left = F.coalesce(left, right)
        right = F.coalesce(right, left)
        lo, hi, cl, cr = left["v"], right["v"], left["cdf"], right["cdf"]
        top = cr >= 1 - 1e-12
        lo = F.when(top & (p >= cr - 1e-12), hi).otherwise(lo)
        if q_method == "lower":
            return lo
        if q_method == "higher":
            return hi
        if q_method == "middle":
            return (lo + hi) / 2
        if q_method == "nearest":
            return F.when(p - cl <= cr - p, lo).otherwise(hi)
        return F.when(cr <= cl, lo).when(F.abs(p - cl) < 1e-12, (lo + hi) / 2).otherwise(lo + (hi - lo) * F.try_divide(p - cl, cr - cl))

    def _points(self, cdf: DataFrame, by: list[str], ps: dict[str, Column | float], q_method: str) -> DataFrame:
        """A row per domain with a column per entry of ``ps``."""
        aggs = []
        for k, p in ps.items():
            left, right = self._invert(p, q_method)
            aggs += [left.alias(f"l_{k}"), right.alias(f"r_{k}")]
        got = grouped(cdf, by, aggs)
        return got.select(*by, *[self._between(F.col(f"l_{k}"), F.col(f"r_{k}"), F.lit(p) if isinstance(p, float) else p, q_method).alias(k) for k, p in ps.items()])

    def _quantile_taylor(self, prep: Prepared, y: str, ps: list[float], q_method: str, alpha: float) -> DataFrame:
        frame, by = prep.frame, prep.frame.by
        cdf = self._cdf(prep, y, F.col("__w"), q_method)
        points = self._points(cdf, by, {f"q{j}": p for j, p in enumerate(ps)}, q_method).persist()
        ok = self._valid([y])
        data = equal(frame.data, points, by)
        w = F.when(ok, F.col("__w")).otherwise(0.0)
        sums = {"w": w, "n": (w > 0).cast("long")} | {f"u{j}": F.when(ok & (F.col(y) > F.col(f"q{j}")), F.col("__w")).otherwise(0.0) for j in range(len(ps))}
        inner = Frame(data, by, frame.strata, frame.psus, frame.ssus, frame.fpc_psu, frame.fpc_ssu, frame.singleton, frame.lone)
        units = unit_sums(inner, sums)
        totals = grouped(units, by, [F.sum(c).alias(f"t_{c}") for c in sums])
        scores = {f"i{j}": (lambda j=j: F.try_divide(F.col(f"u{j}") - F.try_divide(F.col(f"t_u{j}"), F.col("t_w")) * F.col("w"), F.col("t_w"))) for j in range(len(ps))}
        var = equal(variances(units, inner, totals, scores, {k: "n" for k in scores}), totals, by)
        rows = equal(var, points, by).select(*by, *[f"var_i{j}" for j in range(len(ps))], "df_i0", "t_n", *[f"q{j}" for j in range(len(ps))]).collect()
        # one row per domain from here on: the limits' levels need t quantiles
        spark, kinds = self.sample.data.sparkSession, {f.name: f.dataType.simpleString() for f in points.schema.fields}
        levels = []
        for r in rows:
            t = dist.t_ppf(1 - alpha / 2, r["df_i0"]) if r["df_i0"] else math.nan
            for j, p in enumerate(ps):
                half = t * root(r[f"var_i{j}"] or 0.0)
                lo, hi = (min(max(p - half, 0.0), 1.0), min(max(p + half, 0.0), 1.0)) if half == half else (None, None)
                levels.append((*[r[b] for b in by], j, p, r[f"q{j}"], lo, hi, int(r["df_i0"]), int(r["t_n"]), t if t == t else None))
        schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "__j int", "p double", "est double", "lo double", "hi double", "df bigint", "n bigint", "t double"])
        table = spark.createDataFrame(levels, schema)
        both = equal(cdf, table, by) if by else cdf.crossJoin(F.broadcast(table))
        eps = 1e-12
        at = F.struct("cdf", "v")
        aggs = []
        for k in ("lo", "hi"):
            aggs += [F.max(F.when(F.col("cdf") < F.col(k) - eps, at)).alias(f"l_{k}"), F.min(F.when(F.col("cdf") >= F.col(k) - eps, at)).alias(f"r_{k}")]
        got = both.groupBy(*by, "__j", "p", "est", "lo", "hi", "df", "n", "t").agg(*aggs)
        lci, uci = (F.when(F.col(k).isNotNull(), self._between(F.col(f"l_{k}"), F.col(f"r_{k}"), F.col(k), q_method)) for k in ("lo", "hi"))
        out = got.select(*by, F.lit(y).alias("y"), "p", "est", lci.alias("lci"), uci.alias("uci"), "df", "n", "t")
        se = F.try_divide(F.col("uci") - F.col("lci"), 2 * F.col("t"))
        return out.select(*by, "y", "p", "est", se.alias("se"), (se * se).alias("var"), "df", "n", "lci", "uci")

    def _quantile_rep(self, prep: Prepared, y: str, ps: list[float], q_method: str, fay: float, center: str) -> DataFrame:
        by, rw = prep.frame.by, self.sample.design.rep_wgts
        # the main weight is replicate 0: one sort of all replicates' rows, by (domain, replicate, value)
        weights = F.array(F.col("__w"), *[self._rep_weight(r) for r in range(1, rw.n_reps + 1)])
        rows = prep.frame.data.where(self._valid([y])).select(*by, F.col(y).cast("double").alias("v"), F.posexplode(weights).alias("r", "w")).where("w > 0")
        thetas = self._points(_cumulated(rows, [*by, "r"], q_method), [*by, "r"], {f"q{j}": p for j, p in enumerate(ps)}, q_method)
        n = grouped(prep.frame.data, by, [F.count_if(self._valid([y]) & (F.col("__w") > 0)).alias("n")])
        items = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"q{j}").alias("q")) for j, p in enumerate(ps)])
        long = thetas.select(*by, "r", F.explode(items).alias("x")).select(*by, "r", "x.*")
        got = long.groupBy(*by, "p").agg(F.max(F.when(F.col("r") == 0, F.col("q"))).alias("est"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 0, F.struct("r", "q")))), lambda x: x["q"]).alias("theta"))
        v = self._rep_var(F.col("theta"), F.col("est"), fay, center)
        got = equal(got.withColumn("var", v), n, by)
        return got.select(*by, F.lit(y).alias("y"), "p", "est", F.sqrt("var").alias("se"), "var", F.lit(rw.degrees()).cast("long").alias("df"), "n")


def _cumulated(rows: DataFrame, by: list[str], q_method: str) -> DataFrame:
    """(by, v, cdf, total) of rows (by, v, w)."""
    if q_method == "higher":  # ties do not matter
        rows = rows.groupBy(*by, "v").agg(F.sum("w").alias("w"))
    out = running(rows, by, [F.col("v"), F.col("w")], F.col("w"), "upto", total="total")
    return out.select(*by, "v", (F.col("upto") / F.col("total")).alias("cdf"), "total")


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def _deff(kind: str, t, est: Column, v: Column, how: str) -> Column:
    """Variance over that of a simple random sample of as many rows."""
    n, w = t("n").cast("double"), t("w")
    if kind == "ratio":
        spread = F.try_divide(t("yy") - 2 * est * t("xy") + est * est * t("xx"), w)
        base = spread * F.try_divide(n, n - 1) / n * F.pow(F.try_divide(w, t("x")), 2)
    else:
        mean = F.try_divide(t("y"), w)
        base = (F.try_divide(t("yy"), w) - mean * mean) * F.try_divide(n, n - 1) / n
        if kind == "total":
            base = base * w * w
    if how == "wor":
        base = base * (1 - F.try_divide(n, w))
    elif how != "wr":
        raise MethodError("deff must be wor or wr", param="deff")
    return F.when(F.abs(base) > 1e-9, v / base).otherwise(F.lit(float("nan")))
