"""Strata with a single PSU: finding, describing and treating them.

Treatments that move PSUs (certainty, combine, collapse, pool) write a stratum and
a PSU for variances beside the data; those that change the formula (skip, scale,
center) are kept with the sample and used by the estimates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.errors import SingletonError
from quadrat.plans.units import equal

STRATUM, PSU, FLAG = "survey_var_stratum", "survey_var_psu", "survey_singleton"


class Singleton:
    def __init__(self, sample):
        self.sample = sample

    def _need(self) -> tuple[list[str], list[str]]:
        d = self.sample.design
        if not d.stratum or not d.psu:
            raise SingletonError("singletons need a stratum and a PSU", where="singleton")
        return list(d.strata), list(d.psus)

    def _psus(self) -> DataFrame:
        s, p = self._need()
        w = F.col(self.sample.design.wgt).cast("double") if self.sample.design.wgt else F.lit(1.0)
        return self.sample.data.groupBy(*s, *p).agg(F.count("*").alias("n"), F.sum(w).alias("weight"))

    def strata_profile(self) -> DataFrame:
        """A row per stratum: PSUs, rows, weight, mean PSU size, whether it is a singleton."""
        s, _ = self._need()
        return self._psus().groupBy(*s).agg(F.count("*").alias("n_psus"), F.sum("n").alias("n_rows"), F.sum("weight").alias("weight"), F.avg("n").alias("mean_psu_size")).withColumn("is_singleton", F.col("n_psus") == 1)

    def detected(self) -> DataFrame:
        return self.strata_profile().where("is_singleton")

    @property
    def exists(self) -> bool:
        return self.detected().limit(1).count() > 0

    @property
    def count(self) -> int:
        return self.detected().count()

    def keys(self) -> list[tuple]:
        s, _ = self._need()
        return [tuple(r) for r in self.detected().select(*s).orderBy(*s).collect()]

    def summary(self) -> dict:
        r = self.strata_profile().agg(F.count("*"), F.count_if("is_singleton"), F.sum("n_rows"), F.sum(F.when(F.col("is_singleton"), F.col("n_rows")))).first()
        return {"n_strata": r[0], "n_singletons": r[1], "n_rows": r[2] or 0, "n_singleton_rows": r[3] or 0, "share_strata": r[1] / r[0] if r[0] else 0.0}

    def show(self, n: int = 20) -> list[dict]:
        s, p = self._need()
        lone = self.detected().select(*s)
        return [r.asDict() for r in equal(self._psus(), lone, s).orderBy(*s).limit(n).collect()]

    def candidates_for(self, stratum, *, within=None) -> list[dict]:
        """Strata with two PSUs or more that could take a singleton, nearest in size first."""
        s, _ = self._need()
        key = stratum if isinstance(stratum, tuple) else (stratum,)
        rows = [r.asDict() for r in self.strata_profile().collect()]
        me = next((r for r in rows if tuple(r[c] for c in s) == key), None)
        if me is None:
            raise SingletonError(f"no such stratum: {stratum}", where="candidates_for")
        out = [r for r in rows if not r["is_singleton"]]
        if within:
            group = self._group_of(within)
            out = [r for r in out if group[tuple(r[c] for c in s)] == group[key]]
        return sorted(out, key=lambda r: (abs(r["n_rows"] - me["n_rows"]), str([r[c] for c in s])))

    def _group_of(self, within) -> dict[tuple, tuple]:
        s, _ = self._need()
        cols = [within] if isinstance(within, str) else list(within)
        return {tuple(r[c] for c in s): tuple(r[f"__{c}"] for c in cols) for r in self.sample.data.groupBy(*s).agg(*[F.first(c).alias(f"__{c}") for c in cols]).collect()}

    def compare(self, y, *, stratum=None) -> DataFrame:
        """Weighted means of variables by stratum, with the singletons marked."""
        s, _ = self._need()
        w = F.col(self.sample.design.wgt).cast("double") if self.sample.design.wgt else F.lit(1.0)
        ys = [y] if isinstance(y, str) else list(y)
        means = self.sample.data.groupBy(*s).agg(*[F.try_divide(F.sum(w * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"mean_{c}") for c in ys])
        return equal(means, self.strata_profile().select(*s, "n_psus", "n_rows", "is_singleton"), s)

    def rank_strata(self, by: str = "n_rows", descending: bool = False) -> list[dict]:
        s, _ = self._need()
        p = self.strata_profile().where("not is_singleton")
        return [r.asDict() for r in p.orderBy(F.desc(by) if descending else F.asc(by), *s).collect()]

    def suggest_mapping(self, *, using="smallest", within=None, order_by=None, descending=False) -> dict[tuple, tuple]:
        """Where ``collapse`` would put each singleton."""
        s, _ = self._need()
        profile = [r.asDict() for r in self.strata_profile().orderBy(*s).collect()]  # a row per stratum
        key = lambda r: tuple(r[c] for c in s)
        group = self._group_of(within) if within else {key(r): () for r in profile}
        order = sorted(profile, key=lambda r: [str(r[c]) if not isinstance(r[c], (int, float)) else r[c] for c in ([order_by] if isinstance(order_by, str) else order_by or s)], reverse=descending)
        place = {key(r): k for k, r in enumerate(order)}
        size = {key(r): r["n_rows"] for r in profile if not r["is_singleton"]}
        lone = [key(r) for r in order if r["is_singleton"]]
        out: dict[tuple, tuple] = {}
        for k in lone:
            if isinstance(using, dict):
                to = using.get(k, using.get(k[0]))
                out[k] = to if isinstance(to, tuple) else (to,)
                continue
            free = [c for c in size if group[c] == group[k]]
            if not free:
                # no larger stratum: lone strata of one group join each other
                free = [c for c in lone if c != k and group[c] == group[k]]
            if not free:
                raise SingletonError(f"no stratum can take {k}", where="collapse", hint="another within, or pool()")
            if callable(using):
                to = using(k, free)
            elif using in ("smallest", "largest"):
                to = (min if using == "smallest" else max)(free, key=lambda c: (size.get(c, 0), place[c]))
            elif using in ("next", "previous"):
                after = [c for c in free if (place[c] > place[k]) == (using == "next")] or free
                to = min(after, key=lambda c: abs(place[c] - place[k]))
            else:
                raise SingletonError(f"no such rule: {using}", param="using")
            out[k] = to if isinstance(to, tuple) else (to,)
            if out[k] in size:
                size[out[k]] += 1  # the next singleton sees the stratum grown
        return out

    def variance_contributions(self, y: str) -> DataFrame:
        """m / (m - 1) times the squares of PSU totals about their mean, per stratum; null for singletons."""
        s, p = self._need()
        w = F.col(self.sample.design.wgt).cast("double") if self.sample.design.wgt else F.lit(1.0)
        totals = self.sample.data.groupBy(*s, *p).agg(F.sum(w * F.col(y)).alias("t"))
        out = totals.groupBy(*s).agg(F.count("*").alias("n_psus"), F.var_samp("t").alias("v"))
        return out.select(*s, "n_psus", F.when(F.col("n_psus") > 1, F.col("n_psus") * F.col("v")).alias("contribution"))

    # ---- treatments --------------------------------------------------------
    def raise_error(self):
        if keys := self.keys():
            raise SingletonError(f"{len(keys)} strata have a single PSU: {keys[:5]}", where="singleton", hint="collapse, pool, certainty, skip, scale or center")
        return self.sample

    def _flagged(self) -> DataFrame:
        s, _ = self._need()
        lone = self.detected().select(*s).withColumn(FLAG, F.lit(True))
        df = self.sample.data.drop(FLAG, STRATUM, PSU)
        return equal(df, lone, s, "left").withColumn(FLAG, F.coalesce(FLAG, F.lit(False)))

    def _labels(self) -> tuple:
        s, p = self._need()
        join = lambda cs: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs])
        return join(s), join(p), join([*s, *p])

    def certainty(self):
        """A lone PSU is a stratum of its own; its SSUs, or rows, are the units."""
        stratum, psu, full = self._labels()
        d = self.sample.design
        unit = F.concat_ws("|", *[F.col(c).cast("string") for c in d.ssus]) if d.ssu else F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string"))
        df = self._flagged()
        df = df.withColumns({STRATUM: F.when(F.col(FLAG), F.concat(F.lit("certainty|"), full)).otherwise(stratum), PSU: F.when(F.col(FLAG), unit).otherwise(psu)})
        return self.sample._with(df, _singleton={"method": "certainty", "strata": (STRATUM,), "psus": (PSU,)})

    def skip(self):
        """Rows of singletons stay in the data but out of the estimates."""
        return self.sample._with(self._flagged(), _singleton={"method": "skip", "skip": FLAG})

    def scale(self):
        """Variances come from the other strata and are scaled by the share of singletons."""
        info = self.summary()
        return self.sample._with(self._flagged(), _singleton={"method": "scale", "fraction": info["share_strata"], "flag": FLAG})

    def center(self):
        """Lone units deviate from the mean of all units."""
        return self.sample._with(self._flagged(), _singleton={"method": "center"})

    def combine(self, mapping: dict):
        """Strata renamed for variances: ``{from: to}``."""
        s, _ = self._need()
        stratum, _, full = self._labels()
        text = lambda k: "|".join("" if v is None else str(v) for v in (k if isinstance(k, tuple) else (k,)))
        names = {text(k): text(v) for k, v in mapping.items()}
        pairs = [F.lit(x) for kv in names.items() for x in kv]
        moved = F.coalesce(F.create_map(*pairs)[stratum], stratum) if pairs else stratum
        df = self._flagged().withColumns({STRATUM: moved, PSU: full})
        return self.sample._with(df, _singleton={"method": "combine", "strata": (STRATUM,), "psus": (PSU,)})

    def collapse(self, *, using: str | dict | Callable = "smallest", within=None, order_by=None, descending=False, rstate=None):
        """Each singleton joins another stratum."""
        out = self.combine(self.suggest_mapping(using=using, within=within, order_by=order_by, descending=descending))
        return out._with(_singleton=out._singleton | {"method": "collapse"})

    def pool(self, name: str = "__pooled__"):
        """All singletons make one stratum."""
        stratum, _, full = self._labels()
        df = self._flagged().withColumns({STRATUM: F.when(F.col(FLAG), F.lit(name)).otherwise(stratum), PSU: full})
        return self.sample._with(df, _singleton={"method": "pool", "strata": (STRATUM,), "psus": (PSU,)})

    def handle(self, method: str = "error", **kw):
        treat = {"error": self.raise_error, "certainty": self.certainty, "skip": self.skip, "scale": self.scale, "center": self.center, "combine": self.combine, "collapse": self.collapse, "pool": self.pool}
        if method not in treat:
            raise SingletonError(f"no such treatment: {method}", param="method")
        return treat[method](**kw)

    def last_result(self) -> dict:
        return dict(self.sample._singleton)
