"""Generalised linear models with survey weights and design-based covariance.

Every iteration of the fit is one aggregation of the normal equations over a
cached projection; only k x k matrices reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.errors import ModelError
from quadrat.functions import dist
from quadrat.functions.terms import RE, categorical, columns_of, expand, flat, levels
from quadrat.operators.estimation import Estimation
from quadrat.plans.units import Frame, equal, unit_sums, variances

FAMILIES = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse", "inverse_gaussian": "inverse_squared"}
LINKS = ("identity", "logit", "log", "inverse", "inverse_squared")


def link(mu: Column, name: str) -> Column:
    return {"identity": lambda: mu, "logit": lambda: F.ln(mu / (1 - mu)), "log": lambda: F.ln(mu), "inverse": lambda: 1 / mu, "inverse_squared": lambda: 1 / (mu * mu)}[name]()


def mean_of(eta: Column, name: str) -> Column:
    return {"identity": lambda: eta, "logit": lambda: 1 / (1 + F.exp(-eta)), "log": lambda: F.exp(eta), "inverse": lambda: 1 / eta, "inverse_squared": lambda: 1 / F.sqrt(eta)}[name]()


def slope(mu: Column, eta: Column, name: str) -> Column:
    """d mu / d eta."""
    return {"identity": lambda: F.lit(1.0), "logit": lambda: mu * (1 - mu), "log": lambda: mu, "inverse": lambda: -mu * mu, "inverse_squared": lambda: -mu * mu * mu / 2}[name]()


def spread(mu: Column, family: str) -> Column:
    return {"gaussian": lambda: F.lit(1.0), "binomial": lambda: mu * (1 - mu), "poisson": lambda: mu, "gamma": lambda: mu * mu, "inverse_gaussian": lambda: mu * mu * mu}[family]()


def unit_deviance(y: Column, mu: Column, family: str) -> Column:
    xlog = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    return {
        "gaussian": lambda: (y - mu) * (y - mu),
        "binomial": lambda: 2 * (xlog(y, mu) + xlog(1 - y, 1 - mu)),
        "poisson": lambda: 2 * (xlog(y, mu) - (y - mu)),
        "gamma": lambda: 2 * (-F.ln(y / mu) + (y - mu) / mu),
        "inverse_gaussian": lambda: (y - mu) * (y - mu) / (mu * mu * y),
    }[family]()


def start(y: Column, family: str) -> Column:
    return {"gaussian": y, "binomial": (y + 0.5) / 2, "poisson": y + 0.1, "gamma": y, "inverse_gaussian": y}[family]


@dataclass
class GLMFit:
    y: str
    family: str
    link: str
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    df: float
    stats: dict = field(default_factory=dict)
    alpha: float = 0.05

    def coefs(self) -> list[dict]:
        t = dist.t_ppf(1 - self.alpha / 2, self.df)
        out = []
        for n, b, se in zip(self.names, self.beta, np.sqrt(np.maximum(np.diag(self.cov), 0))):
            z = b / se if se else math.nan
            out.append({"term": n, "est": float(b), "se": float(se), "t": float(z), "p_value": dist.t_sf2(z, self.df) if se else math.nan, "lci": float(b - t * se), "uci": float(b + t * se)})
        return out

    def to_df(self, spark) -> DataFrame:
        import pandas as pd

        return spark.createDataFrame(pd.DataFrame(self.coefs()))


class GLM:
    def __init__(self, sample):
        self.sample = sample
        self.fitted: GLMFit | None = None

    coefs = property(lambda self: self._need().coefs())
    stats = property(lambda self: self._need().stats)

    def _need(self) -> GLMFit:
        if self.fitted is None:
            raise ModelError("the model is not fitted", where="GLM")
        return self.fitted

    def fit(self, y: str, *, x=None, intercept=True, family="gaussian", link=None, where=None, drop_nulls=True, tol=1e-8, max_iter=100, alpha=0.05) -> GLM:
        family = family.lower().replace("-", "_")
        if family not in FAMILIES:
            raise ModelError(f"no such family: {family}", param="family")
        link_name = (link or FAMILIES[family]).lower()
        if link_name not in LINKS:
            raise ModelError(f"no such link: {link}", param="link")
        terms = flat(x)
        if any(isinstance(t, RE) for t in terms):
            raise ModelError("random effects cannot be fitted", param="x")
        used = list(dict.fromkeys(c for t in terms for c in columns_of(t)))
        e = Estimation(self.sample)
        prep = e._prepare([y, *used], None, where, drop_nulls)
        ok = e._valid([y, *used])
        found = levels(prep.frame.data.where(ok), categorical(terms))
        pairs = ([("_intercept_", F.lit(1.0))] if intercept else []) + [p for t in terms for p in expand(t, found)]
        if not pairs:
            raise ModelError("the model has no terms", where="fit")
        names, k = [n for n, _ in pairs], len(pairs)
        f = prep.frame
        keys = [*f.strata, *f.psus, *f.ssus, *[c for c in (f.fpc_psu, f.fpc_ssu) if c]]
        reps = self.sample.design.rep_wgts if self.sample.design.method == "replication" else None
        rep_cols = [] if reps is None else ([reps.array] if reps.array else reps.columns)
        w0 = F.when(ok, F.col("__w")).otherwise(0.0)
        yy = F.when(ok, F.col(y).cast("double")).otherwise(0.0)
        data = f.data.select(*dict.fromkeys([*keys, *rep_cols]), w0.alias("__w"), ok.alias("__d"), yy.alias("__y"), *[F.coalesce(c, F.lit(0.0)).alias(f"__x{i}") for i, (_, c) in enumerate(pairs)]).persist()
        n, sw, low, high, odd = data.agg(F.count_if(F.col("__w") > 0), F.sum("__w"), F.min(F.when(F.col("__d"), F.col("__y"))), F.max(F.when(F.col("__d"), F.col("__y"))), F.count_if(F.col("__d") & ~F.col("__y").isin(0.0, 1.0))).first()
        if not n:
            raise ModelError("no rows to fit", where="fit")
        if family == "binomial" and odd:
            raise ModelError("a binomial response must be 0 or 1", param="y")
        if family in ("gamma", "inverse_gaussian") and low <= 0 or family == "poisson" and low < 0:
            raise ModelError(f"the response is outside the {family} family", param="y")
        scaled = data.withColumn("__w", F.col("__w") * F.lit(n / sw))
        beta, bread, dev, iters, done = self._irls(scaled, k, family, link_name, tol, max_iter, "__w")
        if not done:
            raise ModelError(f"no convergence in {max_iter} iterations", where="fit")
        mu, eta, d = self._parts(beta, k, link_name)
        degf = None
        if reps is None:
            base = F.col("__w") * (F.col("__y") - mu) * d / spread(mu, family)
            frame = Frame(scaled.withColumn("__s", F.when(F.col("__w") > 0, base).otherwise(0.0)), [], f.strata, f.psus, f.ssus, f.fpc_psu, f.fpc_ssu, f.singleton or "kernel", f.lone)
            sums = {f"s{i}": F.col("__s") * F.col(f"__x{i}") for i in range(k)} | {"n": (F.col("__w") > 0).cast("long")}
            units = unit_sums(frame, sums)
            one = units.agg(F.lit(1).alias("one"))
            cross = [(f"i{a}", f"i{b}") for a in range(k) for b in range(a + 1, k)]
            got = variances(units, frame, one, {f"i{i}": (lambda i=i: F.col(f"s{i}")) for i in range(k)}, {f"i{i}": "n" for i in range(k)}, cross).first()
            meat = np.diag([got[f"var_i{i}"] for i in range(k)]).astype(float)
            for a, b in cross:
                meat[int(a[1:]), int(b[1:])] = meat[int(b[1:]), int(a[1:])] = got[f"cov_{a}_{b}"]
            cov, degf = bread @ meat @ bread, got["df_i0"]
        else:
            T = self._replicates(data, reps, k, family, link_name, tol, max_iter, beta)
            gap = T - T.mean(axis=0)
            cov, degf = (gap * np.array(reps.coefficients())[:, None]).T @ gap, reps.degrees()
        df = max(1, degf - (k - 1)) if intercept else max(1, degf - k + 1)
        stats = {"n": n, "deviance": dev, "iterations": iters, "df_design": degf}
        stats |= self._model_stats(scaled, beta, cov, names, family, link_name, dev, n, df, intercept, bread)
        data.unpersist()
        self.fitted = GLMFit(y, family, link_name, names, beta, cov, df, stats, alpha)
        self._pairs, self._ok, self._rows = pairs, ok, prep.frame.data
        return self

    @staticmethod
    def _parts(beta: np.ndarray, k: int, link_name: str) -> tuple[Column, Column, Column]:
        eta = sum((F.lit(float(beta[i])) * F.col(f"__x{i}") for i in range(k)), F.lit(0.0))
        mu = mean_of(eta, link_name)
        return mu, eta, slope(mu, eta, link_name)

    @staticmethod
    def _step(rows: DataFrame, weight: str, mu: Column, eta: Column, d: Column, family: str, k: int, by: list[str]) -> DataFrame:
        """Deviance, ``X'WX`` and ``X'Wz`` of one weighted least squares step, a row per ``by``."""
        wi = F.col(weight) * d * d / spread(mu, family)
        z = eta + (F.col("__y") - mu) / d
        now = rows.withColumns({"__wi": wi, "__z": z, "__dv": F.col(weight) * unit_deviance(F.col("__y"), mu, family)})
        aggs = [F.sum("__dv").alias("dev")]
        aggs += [F.sum(F.col("__wi") * F.col(f"__x{i}") * F.col("__z")).alias(f"b{i}") for i in range(k)]
        aggs += [F.sum(F.col("__wi") * F.col(f"__x{a}") * F.col(f"__x{b}")).alias(f"g{a}_{b}") for a in range(k) for b in range(a, k)]
        return now.groupBy(*by).agg(*aggs)

    @staticmethod
    def _solved(r, k: int) -> tuple[np.ndarray, np.ndarray]:
        G = np.zeros((k, k))
        for a in range(k):
            for b in range(a, k):
                G[a, b] = G[b, a] = r[f"g{a}_{b}"]
        if np.linalg.matrix_rank(G) < k:
            raise ModelError("the terms are collinear", where="fit", param="x")
        if not math.isfinite(r["dev"]):
            raise ModelError("the fit diverged", where="fit")
        return np.linalg.solve(G, np.array([r[f"b{i}"] for i in range(k)])), G

    def _replicates(self, data: DataFrame, reps, k: int, family: str, link_name: str, tol: float, max_iter: int, beta: np.ndarray) -> np.ndarray:
        """Coefficients under each replicate's weights, all from ``beta``.

        A step of all replicates is one aggregation; those that have settled leave
        the next.  The driver holds a row of sums per replicate.
        """
        weights = F.col(reps.array) if reps.array else F.array(*[F.col(c).cast("double") for c in reps.columns])
        rows = data.where("__w > 0").select("__y", *[f"__x{i}" for i in range(k)], F.posexplode(weights).alias("__k", "__r"))
        rows = rows.withColumn("__r", F.col("__r").cast("double")).where("__r > 0")
        found, devs, live = np.tile(np.asarray(beta, float), (reps.n_reps, 1)), {}, list(range(reps.n_reps))
        for _ in range(max_iter):
            table = data.sparkSession.createDataFrame([(r, *found[r].tolist()) for r in live], ", ".join(["__k int", *[f"__c{i} double" for i in range(k)]]))
            eta = sum((F.col(f"__c{i}") * F.col(f"__x{i}") for i in range(k)), F.lit(0.0))
            mu = mean_of(eta, link_name)
            got = {r["__k"]: r for r in self._step(rows.join(F.broadcast(table), "__k"), "__r", mu, eta, slope(mu, eta, link_name), family, k, ["__k"]).collect()}
            left = []
            for r in live:
                if r not in got:
                    raise ModelError(f"replicate {r + 1} has no rows", where="fit")
                new, dev = self._solved(got[r], k)[0], got[r]["dev"]
                settled = r in devs and (abs(dev - devs[r]) / (abs(dev) + 0.1) < tol or np.abs(new - found[r]).max() < tol)
                found[r], devs[r] = new, dev
                if not settled and not (family == "gaussian" and link_name == "identity"):
                    left.append(r)
            live = left
            if not live:
                break
        return found

    def _irls(self, data: DataFrame, k: int, family: str, link_name: str, tol: float, max_iter: int, weight: str, beta=None):
        dev, bread = None, None
        rows = data.where(F.col(weight) > 0)
        for it in range(max_iter):
            if beta is None:
                mu = start(F.col("__y"), family)
                eta = link(mu, link_name)
                d = slope(mu, eta, link_name)
            else:
                mu, eta, d = self._parts(beta, k, link_name)
            r = self._step(rows, weight, mu, eta, d, family, k, []).first()
            new, G = self._solved(r, k)
            bread = np.linalg.inv(G)
            settled = beta is not None and dev is not None and (abs(r["dev"] - dev) / (abs(r["dev"]) + 0.1) < tol or np.abs(new - beta).max() < tol)
            old, beta, dev = beta, new, r["dev"]
            if settled:
                return beta, bread, dev, it + 1, True
            if family == "gaussian" and link_name == "identity" and old is not None:
                return beta, bread, dev, it + 1, True
        return beta, bread, dev, max_iter, False

    def _model_stats(self, data, beta, cov, names, family, link_name, dev, n, df, intercept, bread) -> dict:
        out = {}
        rows = data.where(F.col("__w") > 0)
        mean = rows.agg(F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")).first()[0]
        mu, _, _ = self._parts(beta, len(beta), link_name)
        null, pearson = rows.agg(F.sum(F.col("__w") * unit_deviance(F.col("__y"), F.lit(float(mean)), family)), F.sum(F.col("__w") * F.pow(F.col("__y") - mu, 2) / spread(mu, family))).first()
        k = len(beta)
        out |= {"null_deviance": null, "dispersion": pearson / max(n - k, 1), "r2": 1 - dev / null if null else math.nan}
        out["r2_adj"] = 1 - (1 - out["r2"]) * (n - 1) / max(n - k, 1)
        at = [i for i, nme in enumerate(names) if nme != "_intercept_"]
        if at:
            V = cov[np.ix_(at, at)]
            W = float(beta[at] @ np.linalg.pinv(V) @ beta[at])
            p = len(at)
            out |= {"wald_f": W / p, "wald_ndf": p, "wald_ddf": df, "wald_p": dist.f_sf(W / p, p, df)}
        delta = float(np.trace(np.linalg.pinv(bread) @ cov))
        out["daic"] = dev / (out["dispersion"] if family in ("gaussian", "gamma", "inverse_gaussian") else 1.0) + 2 * delta
        return out

    # ---- prediction --------------------------------------------------------
    def _design(self, df: DataFrame, changed: dict | None = None) -> list[Column]:
        return [c for _, c in self._pairs]

    def predict(self, new_data: DataFrame | None = None, alpha=0.05, y_col: str | None = None) -> DataFrame:
        """Rows with yhat, its se (delta method), an interval set on the link scale, and residuals."""
        m = self._need()
        df = self._rows.drop("__d", "__w") if new_data is None else new_data
        x = self._design(df)
        eta = sum((F.lit(float(b)) * c for b, c in zip(m.beta, x)), F.lit(0.0))
        var = sum((F.lit(float(m.cov[a, b])) * x[a] * x[b] for a in range(len(x)) for b in range(len(x))), F.lit(0.0))
        t = dist.t_ppf(1 - alpha / 2, m.df)
        df = df.withColumns({"__eta": eta, "__se": F.sqrt(F.greatest(var, F.lit(0.0)))})
        mu = mean_of(F.col("__eta"), m.link)
        a, b = mean_of(F.col("__eta") - t * F.col("__se"), m.link), mean_of(F.col("__eta") + t * F.col("__se"), m.link)
        out = {"yhat": mu, "se": F.abs(slope(mu, F.col("__eta"), m.link)) * F.col("__se"), "lci": F.least(a, b), "uci": F.greatest(a, b)}
        y = y_col or (m.y if m.y in df.columns else None)
        if y:
            out["residual"] = F.col(y) - mu
        return df.withColumns(out).drop("__eta", "__se")

    def margins(self, at: dict | None = None, variables=None, alpha=0.05) -> list[dict]:
        """Predictive margins at values of a column, or average marginal effects.

        Both are weighted means of k gradient columns, in one aggregation each.
        """
        m = self._need()
        t = dist.t_ppf(1 - alpha / 2, m.df)
        rows = self._rows.where(self._ok).withColumn("__wt", F.col("__w"))
        out = []
        if at:
            for name, values in at.items():
                for v in values if isinstance(values, (list, tuple)) else [values]:
                    fixed = rows.withColumn(name, F.lit(v))
                    est, grad = self._mean_gradient(fixed, lambda eta, mu: mu)
                    out.append(self._margin({"term": name, "at": v, "kind": "margin"}, est, grad, t))
        names = [variables] if isinstance(variables, str) else list(variables or ([] if at else dict.fromkeys(c for n, _ in self._pairs for c in [n] if n in rows.columns)))
        for name in names:
            out.append(self._effect(rows, name, t))
        return out

    def _margin(self, head: dict, est: float, grad: np.ndarray, t: float) -> dict:
        m = self._need()
        se = math.sqrt(max(float(grad @ m.cov @ grad), 0.0))
        return head | {"est": est, "se": se, "lci": est - t * se, "uci": est + t * se, "p_value": dist.t_sf2(est / se, m.df) if se else math.nan}

    def _mean_gradient(self, rows: DataFrame, value) -> tuple[float, np.ndarray]:
        m = self._need()
        x = self._design(rows)
        df = rows.withColumns({f"__x{i}": F.coalesce(c, F.lit(0.0)) for i, c in enumerate(x)})
        mu, eta, d = self._parts(m.beta, len(x), m.link)
        r = df.agg(F.sum("__wt").alias("w"), F.sum(F.col("__wt") * mu).alias("m"), *[F.sum(F.col("__wt") * d * F.col(f"__x{i}")).alias(f"g{i}") for i in range(len(x))]).first()
        return r["m"] / r["w"], np.array([r[f"g{i}"] for i in range(len(x))]) / r["w"]

    def _effect(self, rows: DataFrame, name: str, t: float) -> dict:
        """Average marginal effect of a continuous column, by a central difference of the margins."""
        h = max(1e-4, 1e-4 * abs(rows.agg(F.avg(F.abs(F.col(name)))).first()[0] or 1.0))
        up, gu = self._mean_gradient(rows.withColumn(name, F.col(name) + h), None)
        down, gd = self._mean_gradient(rows.withColumn(name, F.col(name) - h), None)
        return self._margin({"term": name, "at": None, "kind": "effect"}, (up - down) / (2 * h), (gu - gd) / (2 * h), t)

    def to_df(self) -> DataFrame:
        return self._need().to_df(self.sample.data.sparkSession)


def compare(models: list[GLM], names: list[str] | None = None) -> list[dict]:
    """Models side by side: coefficients and fit statistics."""
    out = []
    for k, g in enumerate(models):
        if not isinstance(g, GLM):
            raise ModelError("only fitted models can be compared", where="compare")
        f = g._need()
        out.append({"model": names[k] if names else f"model_{k + 1}", "family": f.family, "link": f.link, **{s: f.stats.get(s) for s in ("n", "deviance", "r2", "daic", "wald_f", "wald_p")}, "coefs": {c["term"]: c["est"] for c in f.coefs()}})
    return out


compare_models = compare
