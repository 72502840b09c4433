"""Tables with Rao-Scott tests, t tests and rank tests under the design."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.design import names
from quadrat.errors import MethodError
from quadrat.functions import dist
from quadrat.operators.estimation import Estimation, Prepared, listed
from quadrat.plans.units import Frame, equal, grouped, root, unit_sums, variances


def level_key(v) -> tuple:
    """Levels in order, numbers as numbers."""
    try:
        return (0, float(v), "")
    except (TypeError, ValueError):
        return (1, 0.0, str(v))


@dataclass
class Table:
    """A one- or two-way table: cells with estimate, se and interval, and test statistics."""

    rowvar: str
    colvar: str | None
    cells: list[dict]
    stats: dict = field(default_factory=dict)
    units: str = "proportion"

    @property
    def is_crosstab(self) -> bool:
        return self.colvar is not None

    @classmethod
    def one_way(cls, rowvar: str, cells: list[dict], **kw) -> Table:
        return cls(rowvar, None, [{"col": None, **c} for c in cells], **kw)

    @classmethod
    def two_way(cls, rowvar: str, colvar: str, cells: list[dict], **kw) -> Table:
        return cls(rowvar, colvar, list(cells), **kw)

    def update(self, **changes) -> Table:
        return replace(self, **changes)

    def add_estimate(self, cell: dict) -> Table:
        return replace(self, cells=[*self.cells, cell])

    def extend_estimates(self, cells: list[dict]) -> Table:
        return replace(self, cells=[*self.cells, *cells])

    def set_stats(self, **stats) -> Table:
        return replace(self, stats={**self.stats, **stats})

    def fill_missing(self, value: float = 0.0) -> Table:
        """Every combination of levels has a cell; the new ones hold ``value``."""
        rows, cols = self.levels()
        have = {(c["row"], c["col"]) for c in self.cells}
        blank = {k: value for k in ("est", "se", "cv", "lci", "uci")}
        return self.extend_estimates([{"row": r, "col": c, **blank} for r in rows for c in (cols or [None]) if (r, c) not in have])

    def use_labels(self, sample) -> Table:
        """Levels replaced by their value labels."""
        name = lambda var, v: sample.resolve_labels(var).get(v, next((x for k, x in sample.resolve_labels(var).items() if str(k) == str(v)), v))
        return replace(self, cells=[{**c, "row": name(self.rowvar, c["row"]), "col": name(self.colvar, c["col"]) if self.colvar else None} for c in self.cells])

    def style(self, decimals: int) -> list[dict]:
        return [{k: round(v, decimals) if isinstance(v, float) else v for k, v in c.items()} for c in self.cells]

    def to_records(self) -> list[dict]:
        return self.cells

    def to_dict(self) -> dict:
        return {"rowvar": self.rowvar, "colvar": self.colvar, "units": self.units, "cells": self.cells, "stats": self.stats}

    def levels(self) -> tuple[list, list]:
        rows = sorted({c["row"] for c in self.cells}, key=level_key)
        cols = sorted({c["col"] for c in self.cells}, key=level_key) if self.colvar else []
        return rows, cols

    def crosstab(self, value: str = "est") -> dict:
        rows, cols = self.levels()
        at = {(c["row"], c["col"]): c[value] for c in self.cells}
        return {r: {k: at.get((r, k)) for k in (cols or [None])} for r in rows}

    def to_df(self, spark) -> DataFrame:
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(self.cells))

    def __str__(self) -> str:
        return "\n".join(f"{c['row']!s:>12} {c['col']!s:>12} {c['est']:.4f} ({c['se']:.4f}) [{c['lci']:.4f}, {c['uci']:.4f}]" for c in self.cells)


@dataclass
class TestResult:
    kind: str
    rows: list[dict]

    def to_dicts(self) -> list[dict]:
        return self.rows

    def __getitem__(self, k):
        return self.rows[k] if isinstance(k, int) else self.rows[0][k]


def p_value(t: float, df: float, alternative: str) -> float:
    if math.isnan(t):
        return math.nan
    upper = 1 - dist.t_cdf(t, df)
    return {"two-sided": dist.t_sf2(t, df), "greater": upper, "less": 1 - upper}[alternative]


class Categorical:
    def __init__(self, sample):
        self.sample = sample
        self.e = Estimation(sample)

    # ---- tables ------------------------------------------------------------
    def tabulate(self, rowvar: str, colvar: str | None = None, *, units="proportion", count_total=None, alpha=0.05, drop_nulls=False, use_labels=None, where=None) -> Table:
        """Cell shares (or percents, or counts) with their covariance from the design.

        The covariance of k cells needs k score sums per unit; one aggregation
        gives all of them and all cross products.
        """
        if units not in ("proportion", "percent", "count"):
            raise MethodError("units must be proportion, percent or count", param="units")
        cols = [rowvar] + ([colvar] if colvar else [])
        prep = self.e._prepare(cols, None, where, drop_nulls)
        ok = self.e._valid(cols)
        found = prep.frame.data.where(ok & (F.col("__w") > 0)).select(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)]).distinct().collect()
        rows = sorted({r["v0"] for r in found}, key=level_key)
        columns = sorted({r["v1"] for r in found}, key=level_key) if colvar else [None]
        cells = [(r, c) for r in rows for c in columns]
        if len(cells) > 400:
            raise MethodError(f"the table would have {len(cells)} cells", where="tabulate", hint="categorize the variables")
        hit = {k: (F.col(rowvar).cast("string") == r) & ((F.col(colvar).cast("string") == c) if colvar else F.lit(True)) for k, (r, c) in enumerate(cells)}
        w = F.when(ok, F.col("__w")).otherwise(0.0)
        sums = {"w": w, "n": (w > 0).cast("long")} | {f"y{k}": F.when(hit[k], w).otherwise(0.0) for k in hit}
        units_df = unit_sums(prep.frame, sums)
        totals = grouped(units_df, [], [F.sum(c).alias(f"t_{c}") for c in sums])
        count = units == "count" and count_total is None
        score = (lambda k: F.col(f"y{k}")) if count else (lambda k: F.try_divide(F.col(f"y{k}") - F.try_divide(F.col(f"t_y{k}"), F.col("t_w")) * F.col("w"), F.col("t_w")))
        scores = {f"i{k}": (lambda k=k: score(k)) for k in hit}
        cross = [(f"i{a}", f"i{b}") for a in hit for b in hit if a < b] if colvar else []
        got = equal(variances(units_df, prep.frame, totals, scores, {s: "n" for s in scores}, cross), totals, []).first()
        m = len(cells)
        W, df = got["t_w"] or 0.0, got["df_i0"]
        est = np.array([(got[f"t_y{k}"] or 0.0) / (1 if count else W) for k in range(m)])
        V = np.zeros((m, m))
        for k in range(m):
            V[k, k] = got[f"var_i{k}"] or 0.0
        for a, b in cross:
            V[int(a[1:]), int(b[1:])] = V[int(b[1:]), int(a[1:])] = got[f"cov_{a}_{b}"] or 0.0
        scale = 100.0 if units == "percent" else float(count_total) if units == "count" and not count else 1.0
        t = dist.t_ppf(1 - alpha / 2, df) if df else math.nan
        out = []
        for k, (r, c) in enumerate(cells):
            se = root(V[k, k])
            if units == "count" or not 0 < est[k] < 1:
                lo, hi = (est[k] - t * se, est[k] + t * se) if units == "count" else (est[k], est[k])
            else:
                z, s = math.log(est[k] / (1 - est[k])), t * se / (est[k] * (1 - est[k]))
                lo, hi = 1 / (1 + math.exp(-(z - s))), 1 / (1 + math.exp(-(z + s)))
            out.append({"row": r, "col": c, "est": float(est[k] * scale), "se": float(se * scale), "cv": float(se / est[k]) if est[k] else math.inf, "lci": float(lo * scale), "uci": float(hi * scale)})
        stats = {"df": df, "n": got["t_n"], "n_strata": got["strata_i0"], "n_psus": got["psus_i0"]}
        if colvar and len(rows) > 1 and len(columns) > 1:
            p = est / est.sum()
            Vp = V if not count else _share_cov(est, V)
            stats |= rao_scott(p, Vp, len(rows), len(columns), got["t_n"], got["psus_i0"] - (got["strata_i0"] if prep.frame.strata else 1))
        return Table(rowvar, colvar, out, stats, units)

    # ---- t tests -----------------------------------------------------------
    def ttest(self, y, *, mean_h0=0.0, group=None, y_pair=None, by=None, where=None, alpha=0.05, alternative="two-sided", drop_nulls=False) -> TestResult:
        """One mean against a value, the mean difference of pairs, or two groups."""
        if alternative not in ("two-sided", "less", "greater"):
            raise MethodError("alternative must be two-sided, less or greater", param="alternative")
        rows = []
        for c in listed(y):
            used = [c, *([y_pair] if y_pair else []), *([group] if group else [])]
            prep = self.e._prepare(used, by, where, drop_nulls)
            ok = self.e._valid(used)
            if not group:
                value = F.col(c) - (F.col(y_pair) if y_pair else F.lit(0.0))
                item = {"fixed": {"y": c}, "y": value, "x": F.lit(1.0), "ok": ok}
                for r in self.e._linear(prep, [item], None, "mean").collect():
                    d = r.asDict()
                    df = max(d["df"] - 1, 1)
                    diff, se = d["est"] - mean_h0, d["se"]
                    rows.append({**{b: d[b] for b in prep.frame.by}, "y": c, "kind": "paired" if y_pair else "one-sample", "est": d["est"], **_t_row(diff, se, df, alpha, alternative)})
                continue
            levels = sorted((r[0] for r in prep.frame.data.where(ok).select(group).distinct().limit(3).collect()), key=level_key)
            if len(levels) != 2:
                raise MethodError(f"{group} must have two levels", param="group")
            for d in self._two_groups(prep, F.col(c).cast("double"), group, levels, ok):
                df = max(d["df"] - 1, 1)
                rows.append({**{b: d[b] for b in prep.frame.by}, "y": c, "kind": "two-sample", "group": group, "levels": levels, "means": [d["m0"], d["m1"]], **_t_row(d["m1"] - d["m0"] - mean_h0, d["se"], df, alpha, alternative)})
        return TestResult("ttest", rows)

    def _two_groups(self, prep: Prepared, value: Column, group: str, levels: list, ok: Column) -> list[dict]:
        """Difference of two weighted means; its score is the difference of the means' scores."""
        w = F.when(ok, F.col("__w")).otherwise(0.0)
        sums = {"n": (w > 0).cast("long")}
        for k, lv in enumerate(levels):
            mine = F.when(F.col(group) == F.lit(lv), w).otherwise(0.0)
            sums |= {f"w{k}": mine, f"y{k}": mine * F.when(ok, value).otherwise(0.0)}
        units = unit_sums(prep.frame, sums)
        totals = grouped(units, prep.frame.by, [F.sum(c).alias(f"t_{c}") for c in sums])
        part = lambda k: F.try_divide(F.col(f"y{k}") - F.try_divide(F.col(f"t_y{k}"), F.col(f"t_w{k}")) * F.col(f"w{k}"), F.col(f"t_w{k}"))
        got = equal(variances(units, prep.frame, totals, {"d": lambda: part(1) - part(0), "a": lambda: part(0), "b": lambda: part(1)}, {"d": "n", "a": "n", "b": "n"}), totals, prep.frame.by)
        out = []
        for r in got.where("t_n > 0").collect():
            d = r.asDict()
            mean = lambda k: d[f"t_y{k}"] / d[f"t_w{k}"] if d[f"t_w{k}"] else math.nan
            out.append({**d, "m0": mean(0), "m1": mean(1), "se": root(d["var_d"] or 0.0), "se0": root(d["var_a"] or 0.0), "se1": root(d["var_b"] or 0.0), "df": d["df_d"]})
        return out

    # ---- rank tests --------------------------------------------------------
    def ranktest(self, y: str, *, group: str, method=None, score_fn=None, by=None, where=None, alpha=0.05, alternative="two-sided", drop_nulls=False) -> TestResult:
        """Wilcoxon or Kruskal-Wallis, van der Waerden, or median scores of weighted mid-ranks.

        ``score_fn(ranks, N)`` gives scores of its own, over arrays.
        """
        method = method or "kruskal-wallis"
        prep = self.e._prepare([y, group], by, where, drop_nulls)
        ok = self.e._valid([y, group])
        by_cols = prep.frame.by
        data = self._ranked(prep, y, ok)
        r, N = F.col("__r"), F.col("__N")
        if score_fn is not None:
            import pandas as pd

            def scores_of(ranks, size):
                return pd.Series(np.asarray(score_fn(ranks.to_numpy(), float(size.iloc[0]) if len(size) else 0.0), float))

            score = F.pandas_udf(scores_of, "double", F.PandasUDFType.SCALAR)
            value = score(r, N)
        elif method in ("wilcoxon", "kruskal", "kruskal-wallis", "rank"):
            value = F.try_divide(r, N)
        elif method in ("vander-waerden", "van-der-waerden", "normal"):
            value = _normal_quantile(F.try_divide(r, N))
        elif method == "median":
            value = (r > N / 2).cast("double")
        else:
            raise MethodError(f"no such rank test: {method}", param="method")
        data = data.withColumn("__s", value)
        f = prep.frame
        prep2 = Prepared(Frame(data, by_cols, f.strata, f.psus, f.ssus, None, None, f.singleton, f.lone))
        levels = sorted((x[0] for x in data.where(ok).select(group).distinct().collect()), key=level_key)
        out = []
        if len(levels) == 2:
            for d in self._two_groups(prep2, F.col("__s"), group, levels, ok):
                df = max(d["df"] - 1, 1)
                out.append({**{b: d[b] for b in by_cols}, "y": y, "group": group, "method": method, "levels": levels, "group_scores": [d["m0"], d["m1"]], "group_ses": [d["se0"], d["se1"]], **_t_row(d["m1"] - d["m0"], d["se"], df, alpha, alternative)})
            return TestResult("ranktest", out)
        if len(levels) < 2:
            raise MethodError(f"{group} must have two levels or more", param="group")
        w = F.when(ok, F.col("__w")).otherwise(0.0)
        sums = {"n": (w > 0).cast("long")}
        for k, lv in enumerate(levels):
            mine = F.when(F.col(group) == F.lit(lv), w).otherwise(0.0)
            sums |= {f"w{k}": mine, f"y{k}": mine * F.coalesce(F.col("__s"), F.lit(0.0))}
        units = unit_sums(prep2.frame, sums)
        totals = grouped(units, by_cols, [F.sum(c).alias(f"t_{c}") for c in sums])
        part = lambda k: F.try_divide(F.col(f"y{k}") - F.try_divide(F.col(f"t_y{k}"), F.col(f"t_w{k}")) * F.col(f"w{k}"), F.col(f"t_w{k}"))
        ks = range(1, len(levels))
        scores = {f"i{k}": (lambda k=k: part(k) - part(0)) for k in ks}
        cross = [(f"i{a}", f"i{b}") for a in ks for b in ks if a < b]
        got = equal(variances(units, prep2.frame, totals, scores, {s: "n" for s in scores}, cross), totals, by_cols)
        for row in got.where("t_n > 0").collect():
            d = row.asDict()
            mean = [d[f"t_y{k}"] / d[f"t_w{k}"] for k in range(len(levels))]
            diff = np.array([mean[k] - mean[0] for k in ks])
            V = np.diag([d[f"var_i{k}"] for k in ks])
            for a, b in cross:
                V[int(a[1:]) - 1, int(b[1:]) - 1] = V[int(b[1:]) - 1, int(a[1:]) - 1] = d[f"cov_{a}_{b}"]
            ndf = len(levels) - 1
            chi = float(diff @ np.linalg.pinv(V) @ diff)
            ddf = max(d["df_i1"] - ndf, 1)
            out.append({**{b: d[b] for b in by_cols}, "y": y, "group": group, "method": method, "levels": levels, "group_scores": mean, "chisq": chi, "f": chi / ndf, "ndf": ndf, "ddf": ddf, "p_value": dist.f_sf(chi / ndf, ndf, ddf)})
        return TestResult("ranktest", out)

    def _ranked(self, prep: Prepared, y: str, ok: Column) -> DataFrame:
        """Rows with the weighted mid-rank ``__r`` (tie-averaged) and the weight total ``__N``.

        Cumulative weights come from the table of values, range-partitioned, so the
        rows themselves are only joined to it.
        """
        by = prep.frame.by
        w = F.when(ok, F.col("__w")).otherwise(0.0)
        base = prep.frame.data.withColumn("__y", F.when(ok, F.col(y).cast("double")))
        # within a tie rows carry their cumulative weights; their plain mean is the tie's rank
        rows = base.where(F.col("__y").isNotNull()).groupBy(*by, "__y").agg(F.sum(w).alias("t"), F.count("*").alias("m"), F.sum(F.col("__w") * F.col("__w")).alias("q"))
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(n, *by, "__y").withColumn("part", F.spark_partition_id()).persist()
        parts = ranged.groupBy(*by, "part").agg(F.sum("t").alias("pt"))
        offs = parts.select(*by, "part", F.coalesce(F.sum("pt").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("o"))
        total = grouped(parts, by, [F.sum("pt").alias("__N")])
        inside = F.sum("t").over(Window.partitionBy(*by, "part").orderBy("__y").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")
        # mean over a tie of (weight before + half the own): each row's mid-rank averaged
        table = equal(equal(ranged, offs, [*by, "part"]), total, by).select(*by, "__y", (F.col("o") + inside + F.col("t") / 2).alias("__r"), "__N")
        return equal(base, table, [*by, "__y"], "left")


def _normal_quantile(p: Column) -> Column:
    """Quantile of the normal law, in Arrow batches: Spark has no such function."""

    def quantile(v):
        return v.map(lambda x: dist.norm_ppf(x) if x is not None and 0 < x < 1 else None).astype(float)

    return F.pandas_udf(quantile, "double", F.PandasUDFType.SCALAR)(p)


def _t_row(diff: float, se: float, df: float, alpha: float, alternative: str) -> dict:
    t = diff / se if se else math.nan
    q = dist.t_ppf(1 - alpha / 2, df)
    return {"diff": diff, "se": se, "t": t, "df": df, "p_value": p_value(t, df, alternative), "lci": diff - q * se, "uci": diff + q * se}


def _share_cov(counts: np.ndarray, V: np.ndarray) -> np.ndarray:
    """Covariance of shares from that of counts."""
    total = counts.sum()
    J = (np.eye(len(counts)) - np.outer(counts / total, np.ones(len(counts)))) / total
    return J @ V @ J.T


def rao_scott(p: np.ndarray, V: np.ndarray, r: int, c: int, n: float, df: float) -> dict:
    """Pearson's chi-square against independence, corrected for the design.

    The generalised design effects are the eigenvalues of the interaction
    contrasts' covariance over that under simple random sampling.
    """
    P = p.reshape(r, c)
    expected = np.outer(P.sum(1), P.sum(0)).ravel()
    keep = expected > 0
    chi = float(n * ((p[keep] - expected[keep]) ** 2 / expected[keep]).sum())
    rows, cols = np.repeat(np.arange(r), c), np.tile(np.arange(c), r)
    main = np.column_stack([np.ones(r * c)] + [(rows == k).astype(float) for k in range(1, r)] + [(cols == k).astype(float) for k in range(1, c)])
    inter = np.column_stack([((rows == a) & (cols == b)).astype(float) for a in range(1, r) for b in range(1, c)])
    D = np.diag(expected)
    C = inter - main @ np.linalg.lstsq(main.T @ D @ main, main.T @ D @ inter, rcond=None)[0]
    inverse = np.diag(np.where(expected > 0, 1 / np.where(expected > 0, expected, 1), 0))
    under = C.T @ D @ C / n
    actual = C.T @ D @ inverse @ V @ inverse @ D @ C
    delta = np.linalg.pinv(under) @ actual
    tr, tr2 = float(np.trace(delta)), float(np.trace(delta @ delta))
    k = (r - 1) * (c - 1)
    out = {"chisq": chi, "chisq_df": k, "chisq_p": dist.chi2_sf(chi, k)}
    if tr > 0 and tr2 > 0:
        ndf = tr * tr / tr2
        out |= {"f": chi / tr, "f_ndf": ndf, "f_ddf": df * ndf, "f_p": dist.f_sf(chi / tr, ndf, df * ndf), "mean_deff": tr / k}
    return out
