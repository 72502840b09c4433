"""Weight adjustments and replicate weights.

Adjustments work on group tables (sums of all weights by class, cell or domain),
so rows meet their factors by a join with a small table and are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.design import BootstrapWeights, BRRWeights, JackknifeWeights, RepWeights, SDRWeights, names
from quadrat.errors import DimensionError, MethodError
from quadrat.functions.terms import Cap, Cat, Cross, categorical, columns_of, expand, flat, levels
from quadrat.plans.units import equal

STATUS = ("rr", "nr", "in", "uk")
_LEAST = 1e-10


def hadamard(order: int) -> np.ndarray:
    """A Hadamard matrix of at least ``order`` rows: doubling and both of Paley's constructions for primes."""
    n = max(order, 1)
    while True:
        h = _hadamard(n)
        if h is not None:
            return h
        n += 1


def _prime(q: int) -> bool:
    return q > 2 and all(q % k for k in range(2, int(math.isqrt(q)) + 1))


def _hadamard(n: int) -> np.ndarray | None:
    if n in (1, 2):
        return np.ones((1, 1), int) if n == 1 else np.array([[1, 1], [1, -1]])
    if n % 4:
        return None
    if (half := _hadamard(n // 2)) is not None:
        return np.block([[half, half], [half, -half]])
    if _prime(n - 1):
        h = np.ones((n, n), int)
        h[1:, 0] = -1
        h[1:, 1:] = _residues(n - 1) + np.eye(n - 1, dtype=int)
        return h
    q = n // 2 - 1
    if q % 4 == 1 and _prime(q):
        c = np.ones((q + 1, q + 1), int)
        c[0, 0], c[1:, 1:] = 0, _residues(q)
        h = np.kron(c, [[1, 1], [1, -1]]) + np.kron(np.eye(q + 1, dtype=int), [[1, -1], [-1, -1]])
        return h * h[0]
    return None


def _residues(q: int) -> np.ndarray:
    """Of i and j: 1 if j - i is a square modulo the prime ``q``, -1 if not, 0 on the diagonal."""
    gap = (np.arange(q) - np.arange(q)[:, None]) % q
    return np.where(gap == 0, 0, np.where(np.isin(gap, np.arange(1, q) ** 2 % q), 1, -1))


class Weighting:
    def __init__(self, sample):
        self.sample = sample

    # ---- helpers -----------------------------------------------------------
    def _weights(self, ignore_reps: bool) -> list[str]:
        d = self.sample.design
        main = self.sample.require_weight("weighting")
        if ignore_reps or not d.rep_wgts:
            return [main]
        if d.rep_wgts.array:
            raise MethodError("adjust replicate weights kept as columns, not as an array", hint="create them with as_array=False")
        return [main, *d.rep_wgts.columns]

    def _finish(self, df: DataFrame, old: list[str], new: list[Column], wgt_name: str, update: bool, **kw):
        named = [wgt_name, *[f"{wgt_name}{r}" for r in range(1, len(old))]]
        df = df.withColumns(dict(zip(named, new)))
        design = self.sample.design
        if update:
            rw = design.rep_wgts
            design = design.update(wgt=wgt_name, rep_wgts=replace(rw, prefix=wgt_name, padding=0) if len(old) > 1 else rw if rw is None else None)
        return self.sample._with(df, design, **kw)

    def _check_cells(self, cells: DataFrame, by: list[str], given: dict, what: str) -> None:
        keys = {tuple(r) if len(by) > 1 else r[0] for r in cells.select(*by).distinct().collect()}
        if keys != set(given):
            lost, more = set(given) - keys, keys - set(given)
            raise MethodError(f"{what} do not match the data's cells; without rows: {sorted(map(str, lost))}, without a value: {sorted(map(str, more))}", where="weighting")

    def _table(self, by: list[str], given: dict, value: str) -> DataFrame:
        types = dict(self.sample.data.dtypes)
        rows = [(*(k if len(by) > 1 else (k,)), float(v)) for k, v in given.items()]
        return self.sample.data.sparkSession.createDataFrame(rows, ", ".join([*[f"`{b}` {types[b]}" for b in by], f"{value} double"]))

    # ---- adjustments -------------------------------------------------------
    def adjust(self, resp_status: str, by=None, *, resp_mapping: dict | None = None, wgt_name="nr_wgt", ignore_reps=False, unknown_to_inelig=True, update_design_wgts=True, respondents_only=True, trimming=None):
        """Move the weight of nonrespondents (and unknown cases) to respondents within classes."""
        by = list(names(by))
        mapping = {k: [k] for k in STATUS}
        if resp_mapping is not None:
            if bad := [k for k in resp_mapping if str(k).lower() not in STATUS]:
                raise MethodError(f"not a response status: {bad}", param="resp_mapping", hint="rr, nr, in, uk")
            mapping = {str(k).lower(): list(v) if isinstance(v, (list, tuple, set)) else [v] for k, v in resp_mapping.items()}
        value = F.lower(F.col(resp_status).cast("string"))
        code = F.lit(None).cast("string")
        for k, labels in mapping.items():
            code = F.when(value.isin([str(x).lower() for x in labels]), k).otherwise(code)
        df = self.sample.data.withColumn("__status", code)
        if unknown := df.where("__status is null").select(resp_status).distinct().limit(10).collect():
            raise MethodError(f"statuses that no entry covers: {[r[0] for r in unknown]}", param="resp_status")
        ws = self._weights(ignore_reps)
        sums = [F.sum(F.when(F.col("__status") == k, F.col(w).cast("double")).otherwise(0.0)).alias(f"__{k}{j}") for j, w in enumerate(ws) for k in STATUS]
        groups = df.groupBy(*by).agg(*sums)
        df = equal(df, groups, by)
        new = []
        for j, w in enumerate(ws):
            rr, nr, inn, uk = (F.col(f"__{k}{j}") for k in STATUS)
            safe = lambda a, b: F.when(b > _LEAST, a / b).otherwise(1.0)
            if unknown_to_inelig:
                a_uk = safe(inn + rr + nr + uk, inn + rr + nr)
                f = {"rr": safe(rr + nr, rr) * a_uk, "in": a_uk}
            else:
                f = {"rr": safe(rr + nr + uk, rr), "in": F.lit(1.0)}
            status = F.col("__status")
            new.append(F.col(w).cast("double") * F.when(status == "rr", f["rr"]).when(status == "in", f["in"]).otherwise(0.0))
        gone = ["__status", *[f"__{k}{j}" for j in range(len(ws)) for k in STATUS]]
        named = [wgt_name, *[f"{wgt_name}{r}" for r in range(1, len(ws))]]
        df = df.withColumns(dict(zip(named, new)))
        if respondents_only:
            df = df.where("__status = 'rr'")
        out = Weighting(self.sample._with(df.drop(*gone)))._finish(df.drop(*gone), ws, [F.col(n) for n in named], wgt_name, update_design_wgts)
        return out.weighting.trim(**trimming) if trimming else out

    def normalize(self, controls=None, *, by=None, wgt_name="norm_wgt", ignore_reps=False, update_design_wgts=True):
        """Scale weights to a control (else to the number of rows), by group if asked."""
        by = list(names(by))
        df, ws = self.sample.data, self._weights(ignore_reps)
        groups = df.groupBy(*by).agg(F.count("*").cast("double").alias("__n"), *[F.sum(F.col(w).cast("double")).alias(f"__s{j}") for j, w in enumerate(ws)])
        if isinstance(controls, dict):
            if not by:
                raise MethodError("controls by group need by", param="controls")
            self._check_cells(df, by, controls, "controls")
            groups = equal(groups, self._table(by, controls, "__c"), by)
        else:
            groups = groups.withColumn("__c", F.lit(float(controls)) if controls is not None else F.col("__n"))
        df = equal(df, groups, by)
        new = [F.col(w).cast("double") * F.try_divide(F.col("__c"), F.col(f"__s{j}")) for j, w in enumerate(ws)]
        out = self._finish(df, ws, new, wgt_name, update_design_wgts)
        return out._with(out.data.drop("__n", "__c", *[f"__s{j}" for j in range(len(ws))]))

    def poststratify(self, controls: dict | None = None, *, factors: dict | None = None, by=None, wgt_name="ps_wgt", ignore_reps=False, update_design_wgts=True, strict=True, trimming=None):
        """Weights of each cell sum to its control, or to its share (``factors``) of the present sum."""
        by = list(names(by))
        if (controls is None) == (factors is None):
            raise MethodError("give either controls or factors", where="poststratify")
        df, ws = self.sample.data, self._weights(ignore_reps)
        given = controls if controls is not None else factors
        if not by:
            if isinstance(given, dict):
                raise MethodError("controls by cell need by", param="by")
            return self.normalize(given, wgt_name=wgt_name, ignore_reps=ignore_reps, update_design_wgts=update_design_wgts)
        self._check_cells(df, by, given, "controls" if controls is not None else "factors")
        groups = df.groupBy(*by).agg(*[F.sum(F.col(w).cast("double")).alias(f"__s{j}") for j, w in enumerate(ws)])
        groups = equal(groups, self._table(by, given, "__c"), by)
        if factors is not None:
            total = groups.agg(*[F.sum(f"__s{j}").alias(f"__t{j}") for j in range(len(ws))])
            scale = sum(factors.values())
            groups = groups.crossJoin(F.broadcast(total))
        rounds = (trimming or {}).get("max_cycles", 10) if trimming else 0
        df = equal(df, groups, by)
        goal = lambda j: F.col("__c") if factors is None else F.col("__c") / scale * F.col(f"__t{j}")
        new = [F.col(w).cast("double") * F.try_divide(goal(j), F.col(f"__s{j}")) for j, w in enumerate(ws)]
        out = self._finish(df, ws, new, wgt_name, update_design_wgts)
        out = out._with(out.data.drop("__c", *[f"__{k}{j}" for j in range(len(ws)) for k in ("s", "t")]))
        if trimming:
            spec = {k: v for k, v in trimming.items() if k != "max_cycles"}
            for _ in range(rounds):
                cut = out.weighting.trim(**spec, wgt_name="__cut")
                again = cut.weighting.poststratify(controls, factors=factors, by=by, wgt_name=wgt_name)
                moved = again.data.agg(F.max(F.abs(F.col("__cut") - F.col(wgt_name)) / F.greatest(F.col(wgt_name), F.lit(1e-12)))).first()[0]
                out = again._with(again.data.drop("__cut", *[f"__cut{j}" for j in range(1, len(ws))]))
                if (moved or 0) < 1e-4:
                    break
        return out

    def controls_margins_template(self, *, margins: dict[str, str | list[str]], cat_na: str = "level", na_label: str = "__NA__") -> dict:
        """A skeleton of controls, NaN for every level of each margin."""
        out = {}
        for name, cols in margins.items():
            keys = list(names(cols))
            rows = self.sample.data.select(*keys).distinct().collect()
            label = lambda v: na_label if v is None else v
            if cat_na == "error" and any(v is None for r in rows for v in r):
                raise MethodError(f"margin {name} has nulls", param="cat_na")
            cells = [tuple(label(v) for v in r) if len(keys) > 1 else label(r[0]) for r in rows]
            out[name] = {c: math.nan for c in sorted(cells, key=str)}
        return out

    def rake(self, *, controls: dict | None = None, factors: dict | None = None, wgt_name="rk_wgt", ignore_reps=False, ll_bound=None, up_bound=None, tol=1e-4, max_iter=100, display_iter=False, update_design_wgts=True, strict=True, trimming=None, margins: dict | None = None):
        """Iterative proportional fitting to the totals of each margin.

        The weights are first summed in the cross-classification of the margins;
        fitting runs on that table, as large as the product of the margins' levels,
        and each cell's factor goes back to its rows.
        """
        if (controls is None) == (factors is None):
            raise MethodError("give either controls or factors", where="rake")
        given = controls if controls is not None else factors
        keys = {m: list(names((margins or {}).get(m, m))) for m in given}
        cols = list(dict.fromkeys(c for k in keys.values() for c in k))
        df, ws = self.sample.data, self._weights(ignore_reps)
        cells = df.groupBy(*cols).agg(*[F.sum(F.col(w).cast("double")).alias(f"__s{j}") for j, w in enumerate(ws)], F.count("*").alias("__n")).collect()
        s = np.array([[r[f"__s{j}"] for j in range(len(ws))] for r in cells], float).reshape(len(cells), len(ws))
        place, goal = [], []
        for m, table in given.items():
            slot = {k: i for i, k in enumerate(table)}
            at = [tuple(r[c] for c in keys[m]) if len(keys[m]) > 1 else r[keys[m][0]] for r in cells]
            if set(at) != set(slot):
                raise MethodError(f"controls of margin {m} do not match the data's levels", where="rake", param="controls")
            place.append(np.array([slot[k] for k in at]))
            values = np.array(list(table.values()), float)
            goal.append(values if controls is not None else values / values.sum())
        f = np.ones_like(s)
        done = False
        for n in range(max_iter):
            worst = 0.0
            for at, t in zip(place, goal):
                now = np.zeros((len(t), s.shape[1]))
                np.add.at(now, at, s * f)
                want = t[:, None] if controls is not None else t[:, None] * s.sum(axis=0)
                if ((now <= 0) & (want > 0)).any():
                    raise MethodError("a level with a positive control has no weight", where="rake")
                step = np.where(now > 0, want / np.where(now > 0, now, 1), 1.0)
                worst = max(worst, float(np.abs(step - 1).max()))
                f *= step[at]
            if display_iter:
                print(f"iteration {n + 1}: {worst:.3e}")
            if worst < tol:
                done = True
                break
        if not done and strict:
            raise MethodError(f"no convergence in {max_iter} iterations", where="rake", hint="strict=False, or more iterations")
        main = f[:, 0]
        if (ll_bound is not None and (main < ll_bound).any()) or (up_bound is not None and (main > up_bound).any()):
            if strict:
                raise MethodError("weight ratios leave the bounds", where="rake")
        types = dict(df.dtypes)
        rows = [(*[r[c] for c in cols], *map(float, f[i])) for i, r in enumerate(cells)]
        table = df.sparkSession.createDataFrame(rows, ", ".join([*[f"`{c}` {types[c]}" for c in cols], *[f"__f{j} double" for j in range(len(ws))]]))
        out = equal(df, table, cols)
        out = self._finish(out, ws, [F.col(w).cast("double") * F.col(f"__f{j}") for j, w in enumerate(ws)], wgt_name, update_design_wgts)
        out = out._with(out.data.drop(*[f"__f{j}" for j in range(len(ws))]))
        if trimming:
            spec = {k: v for k, v in trimming.items() if k != "max_cycles"}
            for _ in range(trimming.get("max_cycles", 10)):
                cut = out.weighting.trim(**spec, wgt_name="__cut")
                again = cut.weighting.rake(controls=controls, factors=factors, wgt_name=wgt_name, tol=tol, max_iter=max_iter, margins=margins)
                moved = again.data.agg(F.max(F.abs(F.col("__cut") - F.col(wgt_name)) / F.greatest(F.col(wgt_name), F.lit(1e-12)))).first()[0]
                out = again._with(again.data.drop("__cut", *[f"__cut{j}" for j in range(1, len(ws))]))
                if (moved or 0) < tol:
                    break
        return out

    # ---- calibration -------------------------------------------------------
    def _aux(self, terms: list, by: list[str] = ()) -> list[tuple[str, Column]]:
        found = levels(self.sample.data, categorical(terms))
        return [pair for t in terms for pair in expand(t, found, full=True)]

    def build_aux_matrix(self, *, x, by=None, by_na="error", na_label="__NA__") -> tuple[DataFrame, dict]:
        """Rows with the auxiliary columns of terms, and a template of their controls."""
        pairs = self._aux(flat(x))
        df = self.sample.data.select(*names(by), *[c.alias(n) for n, c in pairs])
        return df, {n: math.nan for n, _ in pairs}

    def control_aux_template(self, *, x, by=None, by_na="error", na_label="__NA__") -> dict:
        keys = [n for n, _ in self._aux(flat(x))]
        by = list(names(by))
        if not by:
            return {k: math.nan for k in keys}
        domains = [tuple(r) if len(by) > 1 else r[0] for r in self.sample.data.select(*by).distinct().collect()]
        return {d: {k: math.nan for k in keys} for d in domains}

    def calibrate(self, *, controls: dict, by=None, scale=1.0, bounded=False, wgt_name="calib_wgt", update_design_wgts=True, ignore_reps=False, strict=True, trimming=None):
        """Linear calibration: weights w (1 + x'l / scale) meet the controls of the terms.

        ``controls`` maps a term to its total, a category to ``{level: total}``.
        """
        if bounded:
            raise MethodError("bounded calibration is not there", param="bounded")
        by = list(names(by))
        tables = controls if by else {None: controls}
        first = next(iter(tables.values()))
        terms = list(first)
        found = levels(self.sample.data, categorical(terms))
        pairs, keys = [], []
        for t in terms:
            value = first[t]
            if isinstance(value, dict):
                for (n, c), level in zip(expand(t, found, full=True), _level_keys(t, found)):
                    if level not in value:
                        raise MethodError(f"no control for {n}", param="controls")
                    pairs.append((n, c))
                    keys.append((t, level))
            else:
                pairs += expand(t, found, full=True)
                keys.append((t, None))
        goals = {d: [float(tab[t][lv]) if lv is not None else float(tab[t]) for t, lv in keys] for d, tab in tables.items()}
        return self._calibrated([c for _, c in pairs], goals, by, scale, wgt_name, update_design_wgts, ignore_reps, strict, trimming)

    def calibrate_matrix(self, *, aux_vars, control, by=None, scale=1.0, bounded=False, wgt_name="calib_wgt", update_design_wgts=True, ignore_reps=False, strict=True, trimming=None, labels=None, weights_only=False):
        """As ``calibrate``, the auxiliary variables given as column names in order."""
        by = list(names(by))
        cols = [F.col(c).cast("double") for c in aux_vars]
        goals = {d: list(map(float, v.values() if isinstance(v, dict) else v)) for d, v in control.items()} if by else {None: list(map(float, control.values() if isinstance(control, dict) else control))}
        return self._calibrated(cols, goals, by, scale, wgt_name, update_design_wgts, ignore_reps, strict, trimming)

    def _calibrated(self, x: list[Column], goals: dict, by: list[str], scale, wgt_name, update, ignore_reps, strict, trimming):
        df, ws = self.sample.data, self._weights(ignore_reps)
        k = len(x)
        df = df.withColumns({f"__x{i}": F.coalesce(c.cast("double"), F.lit(0.0)) for i, c in enumerate(x)} | {"__c": F.greatest(F.col(scale).cast("double"), F.lit(1e-10)) if isinstance(scale, str) else F.lit(max(float(scale), 1e-10))})
        aggs = []
        for j, w in enumerate(ws):
            wc = F.col(w).cast("double")
            aggs += [F.sum(wc * F.col(f"__x{i}")).alias(f"__t{j}_{i}") for i in range(k)]
            aggs += [F.sum(wc / F.col("__c") * F.col(f"__x{a}") * F.col(f"__x{b}")).alias(f"__g{j}_{a}_{b}") for a in range(k) for b in range(a, k)]
        rows = []
        for r in df.groupBy(*by).agg(*aggs).collect():
            d = (tuple(r[b] for b in by) if len(by) > 1 else r[by[0]]) if by else None
            if d not in goals:
                raise MethodError(f"no controls for domain {d}", where="calibrate")
            lam = []
            for j in range(len(ws)):
                gram = np.zeros((k, k))
                for a in range(k):
                    for b in range(a, k):
                        gram[a, b] = gram[b, a] = r[f"__g{j}_{a}_{b}"]
                gap = np.array(goals[d]) - np.array([r[f"__t{j}_{i}"] for i in range(k)])
                sol = np.linalg.lstsq(gram, gap, rcond=1e-12)[0]
                if strict and not np.allclose(gram @ sol, gap, rtol=1e-6, atol=1e-6 * max(1.0, np.abs(goals[d]).max())):
                    raise MethodError("the controls cannot be met", where="calibrate", hint="collinear terms or contradictory totals")
                lam += sol.tolist()
            rows.append((*[r[b] for b in by], *lam))
        types = dict(df.dtypes)
        table = df.sparkSession.createDataFrame(rows, ", ".join([*[f"`{b}` {types[b]}" for b in by], *[f"__l{j}_{i} double" for j in range(len(ws)) for i in range(k)]]))
        out = equal(df, table, by)
        new = []
        for j, w in enumerate(ws):
            step = sum((F.col(f"__x{i}") * F.col(f"__l{j}_{i}") for i in range(k)), F.lit(0.0))
            new.append(F.col(w).cast("double") * (1 + step / F.col("__c")))
        made = self._finish(out, ws, new, wgt_name, update)
        made = made._with(made.data.drop("__c", *[f"__x{i}" for i in range(k)], *[f"__l{j}_{i}" for j in range(len(ws)) for i in range(k)]))
        return made.weighting.trim(**trimming) if trimming else made

    # ---- trimming ----------------------------------------------------------
    def trim(self, upper=None, lower=None, by=None, redistribute=True, min_cell_size=10, max_iter=10, tol=1e-6, wgt_name="trim_wgt", update_design_wgts=True):
        """Cap (and floor) weights, handing the excess to weights inside, until little moves.

        A threshold is a number above 1, a quantile in (0, 1], a ``Cap``, or a
        function of the weights.  Zero weights stay; replicates take the main
        weight's factor.
        """
        by = list(names(by))
        df, ws = self.sample.data, self._weights(False)
        w0 = F.col(ws[0]).cast("double")
        df = df.withColumn("__w", w0)
        limits = self._limits(df, by, {"hi": upper, "lo": lower}, min_cell_size)
        df = equal(df, limits, by)
        for _ in range(max_iter):
            w, hi, lo = F.col("__w"), F.col("__hi"), F.col("__lo")
            over, under = w > hi, (w < lo) & (w > 0)
            sums = df.groupBy(*by).agg(
                F.coalesce(F.sum(F.when(over, w - hi)), F.lit(0.0)).alias("__ex"),
                F.coalesce(F.sum(F.when(w < hi, w)), F.lit(0.0)).alias("__in"),
                F.coalesce(F.sum(F.when(under, lo - w)), F.lit(0.0)).alias("__de"),
                F.coalesce(F.sum(F.when(w > lo, w - lo)), F.lit(0.0)).alias("__do"),
                F.coalesce(F.sum(w), F.lit(0.0)).alias("__all"),
            )
            moved = sums.agg(F.sum(F.col("__ex") + F.when(F.col("__do") > F.col("__de"), F.col("__de")).otherwise(0.0)), F.sum("__all")).first()
            if not moved[1] or (moved[0] or 0.0) / moved[1] <= tol:
                break
            df = equal(df, sums, by)
            share = F.when(F.col("__in") > 0, 1 + F.col("__ex") / F.col("__in")).otherwise(1.0) if redistribute else F.lit(1.0)
            capped = F.when(over, hi).when((w > 0) & (w < hi), w * share).otherwise(w)
            can = F.col("__do") > F.col("__de")
            take = F.when(F.col("__do") > 0, F.col("__de") / F.col("__do")).otherwise(0.0) if redistribute else F.lit(0.0)
            floored = F.when(can & (w > 0) & (w < lo), lo).when(can & (capped > lo), capped - (capped - lo) * take).otherwise(capped)
            df = df.withColumn("__w", floored).drop("__ex", "__in", "__de", "__do", "__all")
            if not redistribute:
                break
        factor = F.when(w0 != 0, F.col("__w") / w0).otherwise(1.0)
        out = self._finish(df, ws, [F.col("__w"), *[F.col(w).cast("double") * factor for w in ws[1:]]], wgt_name, update_design_wgts)
        return out._with(out.data.drop("__w", "__hi", "__lo"))

    def _limits(self, df: DataFrame, by: list[str], given: dict, least: int) -> DataFrame:
        aggs = [F.count("*").alias("__n")]
        w = F.when(F.col("__w") > 0, F.col("__w"))
        edge = {"hi": 1e300, "lo": 0.0}  # no limit
        for k, t in given.items():
            if t is None:
                aggs.append(F.lit(edge[k]).alias(f"__{k}"))
            elif isinstance(t, Cap):
                stats = {"median": F.median(w), "mean": F.avg(w), "iqr": F.percentile(w, F.lit(0.75)) - F.percentile(w, F.lit(0.25))}
                if t.stat not in stats:
                    raise MethodError(f"no such statistic: {t.stat}", param="Cap")
                base = F.median(w) + t.k * stats["iqr"] if t.stat == "iqr" else t.k * stats[t.stat]
                aggs.append(base.alias(f"__{k}"))
            elif callable(t):
                if by:
                    raise MethodError("a function cannot be used with by", param="upper")
                import pandas as pd

                # the function asks for all weights; they are one column
                values = df.select("__w").toPandas()["__w"]
                aggs.append(F.lit(float(t(pd.Series(values)))).alias(f"__{k}"))
            elif 0 < t <= 1:
                aggs.append(F.percentile(w, F.lit(float(t))).alias(f"__{k}"))
            else:
                aggs.append(F.lit(float(t)).alias(f"__{k}"))
        out = df.groupBy(*by).agg(*aggs)
        small = F.col("__n") < least
        if by:
            out = out.withColumns({f"__{k}": F.when(small, edge[k]).otherwise(F.col(f"__{k}")) for k in given})
        return out.drop("__n")

    # ---- replicate weights -------------------------------------------------
    def _psu_table(self, order_by=None, rstate=None, shuffle=False) -> DataFrame:
        """A row per PSU with its place ``__k`` in the stratum (from 0) and the stratum's size ``__m``."""
        d = self.sample.design
        if not d.psu:
            raise DimensionError("replicate weights need a PSU", where="weighting")
        keys = [*d.strata, *d.psus]
        df = self.sample.data
        order = [order_by] if isinstance(order_by, str) else list(order_by or [])
        table = df.groupBy(*keys).agg(*[F.min(c).alias(f"__o{i}") for i, c in enumerate(order)] or [F.lit(0).alias("__o0")])
        sort = [F.xxhash64(F.lit(rstate or 0), *d.psus)] if shuffle else [F.col(f"__o{i}") for i in range(max(len(order), 1))]
        w = Window.partitionBy(*d.strata)
        return table.withColumns({"__k": F.row_number().over(w.orderBy(*sort, *d.psus)) - 1, "__m": F.count("*").over(w)}).select(*keys, "__k", "__m")

    def create_variance_strata(self, *, method: str, order_by=None, shuffle=False, into="survey_var_stratum", rstate=None):
        """Pairs of neighbouring PSUs as strata (``brr``), or pairs with a triple at the end (``jk2``)."""
        if method not in ("brr", "jk2"):
            raise MethodError("method must be brr or jk2", param="method")
        d = self.sample.design
        table = self._psu_table(order_by, rstate, shuffle)
        pair = F.floor(F.col("__k") / 2)
        if method == "brr":
            if table.where("__m % 2 = 1").limit(1).count():
                raise DimensionError("brr needs an even number of PSUs in every stratum", where="create_variance_strata")
        else:
            pair = F.when((F.col("__m") > 1) & (F.col("__m") % 2 == 1) & (F.col("__k") == F.col("__m") - 1), pair - 1).otherwise(pair)
        label = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in d.strata], (pair + 1).cast("string"))
        keys = [*d.strata, *d.psus]
        out = equal(self.sample.data, table.select(*keys, label.alias(into)), keys)
        return self.sample._with(out, d.update(stratum=into))

    def _replicated(self, multipliers: DataFrame, keys: list[str], n: int, prefix: str | None, made: Callable[[str], RepWeights], as_array: bool = False):
        """Rows times their PSU's array ``__f`` of multipliers, as columns or as one array."""
        d = self.sample.design
        prefix = prefix or "rep_wgt"
        w = F.col(d.wgt).cast("double") if d.wgt else F.lit(1.0)
        df = equal(self.sample.data, multipliers, keys)
        if as_array:
            df = df.withColumn(prefix, F.transform("__f", lambda f: w * f)).drop("__f")
            return self.sample._with(df, d.update(rep_wgts=replace(made(prefix), array=prefix)))
        df = df.withColumns({f"{prefix}{r}": w * F.col("__f")[r - 1] for r in range(1, n + 1)}).drop("__f")
        return self.sample._with(df, d.update(rep_wgts=made(prefix)))

    def create_brr_wgts(self, n_reps: int | None = None, *, rep_prefix=None, fay_coef=0.0, rstate=None, drop_nulls=False, as_array=False):
        """Balanced half-samples: exactly two PSUs in every stratum."""
        d, table = self.sample.design, self._psu_table(rstate=rstate, shuffle=rstate is not None)
        strata = table.groupBy(*d.strata).agg(F.max("__m").alias("__m")).orderBy(*d.strata)
        rows = strata.collect()
        if any(r["__m"] != 2 for r in rows):
            raise DimensionError("brr needs exactly two PSUs in every stratum", where="create_brr_wgts", hint="create_variance_strata(method='brr')")
        h = hadamard(max(len(rows) + 1, n_reps or 0))
        if n_reps and n_reps > len(h):
            raise MethodError("n_reps is larger than the matrix", param="n_reps")
        n = len(h)
        types = dict(self.sample.data.dtypes)
        plan = [(*[r[c] for c in d.strata], [float(x) for x in h[i + 1]]) for i, r in enumerate(rows)]
        signs = self.sample.data.sparkSession.createDataFrame(plan, ", ".join([*[f"`{c}` {types[c]}" for c in d.strata], "__h array<double>"]))
        table = equal(table, signs, list(d.strata))
        first = F.col("__k") == 0
        f = F.transform("__h", lambda x: F.when((x > 0) == first, 2 - fay_coef).otherwise(fay_coef))
        keys = [*d.strata, *d.psus]
        return self._replicated(table.select(*keys, f.alias("__f")), keys, n, rep_prefix, lambda p: BRRWeights(p, n, df=len(rows), fay_coef=fay_coef), as_array)

    def create_jk_wgts(self, *, paired=False, rep_prefix=None, rstate=None, drop_nulls=False, as_array=False):
        """Delete one PSU at a time (one per pair if ``paired``)."""
        d, table = self.sample.design, self._psu_table(rstate=rstate, shuffle=rstate is not None)
        keys = [*d.strata, *d.psus]
        if paired:
            strata = [tuple(r[c] for c in d.strata) for r in table.select(*d.strata).distinct().orderBy(*d.strata).collect()] if d.strata else [()]
            if table.where("__m not in (2, 3)").limit(1).count():
                raise DimensionError("paired jackknife needs pairs or triples", where="create_jk_wgts", hint="create_variance_strata(method='jk2')")
            number = F.dense_rank().over(Window.orderBy(*d.strata)) if d.strata else F.lit(1)
            n = len(strata)
            f = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda r: F.when(r != F.col("__r"), 1.0).when(F.col("__k") == 0, 0.0).otherwise(F.col("__m") / (F.col("__m") - 1)))
            plan = table.withColumn("__r", number).select(*keys, f.alias("__f"))
            return self._replicated(plan, keys, n, rep_prefix, lambda p: JackknifeWeights(p, n, df=n, rscales=(1.0,) * n, paired=True), as_array)
        rows = table.orderBy(*keys).collect()  # one replicate per PSU, so PSUs are as few as replicates
        n = len(rows)
        types = dict(self.sample.data.dtypes)
        ids = self.sample.data.sparkSession.createDataFrame([(*[r[c] for c in keys], i + 1) for i, r in enumerate(rows)], ", ".join([*[f"`{c}` {types[c]}" for c in keys], "__r int"]))
        spans = {}
        for i, r in enumerate(rows):
            spans.setdefault(tuple(r[c] for c in d.strata), []).append(i + 1)
        table = equal(table, ids, keys)
        group = self.sample.data.sparkSession.createDataFrame([(*k, min(v), max(v)) for k, v in spans.items()], ", ".join([*[f"`{c}` {types[c]}" for c in d.strata], "__a int", "__z int"]))
        table = equal(table, group, list(d.strata))
        m = F.col("__m")
        f = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda r: F.when(r == F.col("__r"), F.when(m > 1, 0.0).otherwise(1.0)).when(r.between(F.col("__a"), F.col("__z")), m / F.nullif(m - 1, F.lit(0))).otherwise(1.0))
        scales = tuple((r["__m"] - 1) / r["__m"] for r in rows)
        return self._replicated(table.select(*keys, f.alias("__f")), keys, n, rep_prefix, lambda p: JackknifeWeights(p, n, df=n - len(spans), rscales=scales), as_array)

    def create_bs_wgts(self, n_reps: int = 500, *, kind="rao-wu", rep_prefix=None, drop_nulls=False, rstate=None, as_array=False):
        """Rao-Wu rescaling bootstrap (PSUs), or the Poisson bootstrap (rows)."""
        d, seed = self.sample.design, int(rstate or 0)
        if kind == "poisson":
            w = F.col(self.sample.require_weight("create_bs_wgts")).cast("double")
            if self.sample.data.where(w < 1).limit(1).count():
                raise MethodError("the Poisson bootstrap needs weights of at least 1", where="create_bs_wgts")
            prefix = rep_prefix or "rep_wgt"
            # signs hang on a row's values, and on its number among equal rows, not on partitions
            given = [F.col(f"`{c}`") for c in self.sample.data.columns if not c.startswith("__")]
            same = Window.partitionBy("__row").orderBy("__row")
            df = self.sample.data.withColumn("__row", F.xxhash64(F.lit(seed), *given)).withColumn("__k", F.row_number().over(same))
            sign = lambda r: F.when(F.xxhash64(F.lit(r), "__row", "__k") % 2 == 0, 1.0).otherwise(-1.0)
            cols = {f"{prefix}{r}": w + sign(r) * w * F.sqrt((w - 1) / w) for r in range(1, n_reps + 1)}
            return self.sample._with(df.withColumns(cols).drop("__row", "__k"), d.update(rep_wgts=BootstrapWeights(prefix, n_reps)))
        if kind != "rao-wu":
            raise MethodError("kind must be rao-wu or poisson", param="kind")
        keys = [*d.strata, *d.psus]
        table = self._psu_table().withColumn("__s", F.xxhash64(F.lit(seed), *(d.strata or [F.lit(0)])))

        def draw(pdf):
            n = len(pdf)
            pdf = pdf.sort_values("__k")
            if n == 1:
                f = np.ones((1, n_reps))
            else:
                rng = np.random.default_rng(abs(int(pdf["__s"].iloc[0])))
                f = rng.multinomial(n - 1, np.full(n, 1 / n), size=n_reps).T * (n / (n - 1))
            return pdf[keys].assign(__f=list(f.astype(float)))

        types = dict(self.sample.data.dtypes)
        schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "__f array<double>"])
        # a stratum's PSUs are drawn together
        plan = table.groupBy("__s", *d.strata).applyInPandas(lambda pdf: draw(pdf), schema)
        return self._replicated(plan, keys, n_reps, rep_prefix, lambda p: BootstrapWeights(p, n_reps), as_array)

    def create_sdr_wgts(self, n_reps: int = 4, *, rep_prefix=None, order_col=None, drop_nulls=False, as_array=False):
        """Successive differences: rows (or PSUs) in order, the table's if none is named, meet neighbouring rows of a Hadamard matrix."""
        d = self.sample.design
        h = hadamard(max(n_reps, 4))
        n = len(h)
        flat_h = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in h])
        rows = n - 1 if n > 1 else 1

        def multipliers(k: Column) -> Column:
            a, b = F.get(flat_h, (k % rows + 1).cast("int")), F.get(flat_h, ((k + 1) % rows + 1).cast("int"))
            return F.zip_with(a, b, lambda x, y: 1 + 2**-1.5 * (x - y))

        if d.psu:
            keys = [*d.strata, *d.psus]
            table = self._psu_table(order_col).select(*keys, multipliers(F.col("__k")).alias("__f"))
            return self._replicated(table, keys, n, rep_prefix, lambda p: SDRWeights(p, n), as_array)
        order = F.col(order_col) if order_col else F.monotonically_increasing_id()
        k = F.row_number().over(Window.partitionBy(*d.strata).orderBy(order)) - 1
        df = self.sample.data.withColumn("__f", multipliers(k))
        prefix = rep_prefix or "rep_wgt"
        w = F.col(d.wgt).cast("double") if d.wgt else F.lit(1.0)
        df = df.withColumns({f"{prefix}{r}": w * F.col("__f")[r - 1] for r in range(1, n + 1)}).drop("__f")
        return self.sample._with(df, d.update(rep_wgts=SDRWeights(prefix, n)))


def _level_keys(term, found: dict[str, list]) -> list:
    """Keys of a term's levels, as controls name them: a value, or a tuple for a product."""
    if isinstance(term, Cat):
        return list(found[term.name])
    if isinstance(term, Cross):
        join = lambda a, b: ((a if isinstance(a, tuple) else (a,)) + (b if isinstance(b, tuple) else (b,)))
        return [join(a, b) for a in _level_keys(term.left, found) for b in _level_keys(term.right, found)]
    return [columns_of(term)[0]]
