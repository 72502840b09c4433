"""Drawing samples from a frame: simple random, with probability proportional to size, in stages.

Draws are fixed by a seed and the row's values, not by where the row lies, so they
are the same on any number of partitions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.design import names
from quadrat.errors import DimensionError, MethodError
from quadrat.plans.prefix import running
from quadrat.plans.units import equal
from quadrat.plans.where import predicate


def hamilton(shares: dict, total: int) -> dict:
    """Whole numbers that sum to ``total``: floors, then the largest fractions."""
    out = {k: math.floor(v) for k, v in shares.items()}
    rest = total - sum(out.values())
    for k in sorted(shares, key=lambda k: (-(shares[k] - math.floor(shares[k])), str(k)))[: max(rest, 0)]:
        out[k] += 1
    return out


class Selection:
    def __init__(self, sample):
        self.sample = sample

    # ---- sizes -------------------------------------------------------------
    def _groups(self, by) -> list[str]:
        return list(dict.fromkeys([*self.sample.design.strata, *names(by)]))

    def group_sizes(self, *, by=None) -> dict:
        keys = self._groups(by)
        rows = self.sample.data.groupBy(*keys).count().collect()
        return {(tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]] if keys else None): r["count"] for r in rows}

    def allocate(self, group_sizes: dict, *, method="proportional", n_total=None, n_per_group=None, rate=None, group_sds=None, min_n=1, cap_at_population=True) -> dict:
        """Sample sizes by group: proportional, neyman, equal or rate."""
        N = {k: float(v) for k, v in group_sizes.items()}
        if method == "rate":
            rates = rate if isinstance(rate, dict) else {k: rate for k in N}
            out = {k: math.ceil(N[k] * rates[k] - 1e-12) for k in N}
        elif method == "equal":
            if n_per_group is None and n_total is None:
                raise MethodError("equal needs n_per_group or n_total", where="allocate")
            out = {k: int(n_per_group) for k in N} if n_per_group is not None else hamilton({k: n_total / len(N) for k in N}, n_total)
        elif method in ("proportional", "neyman"):
            if n_total is None:
                raise MethodError(f"{method} needs n_total", param="n_total")
            if method == "neyman" and not group_sds:
                raise MethodError("neyman needs group_sds", param="group_sds")
            size = {k: N[k] * (float(group_sds[k]) if method == "neyman" else 1.0) for k in N}
            whole = sum(size.values())
            out = hamilton({k: n_total * v / whole for k, v in size.items()}, n_total)
        else:
            raise MethodError(f"no such allocation: {method}", param="method")
        out = {k: max(v, min_n) for k, v in out.items()}
        if cap_at_population:
            # what a small group cannot give is dealt to the others
            over = sum(max(0, v - int(N[k])) for k, v in out.items())
            out = {k: min(v, int(N[k])) for k, v in out.items()}
            if over and method in ("proportional", "neyman"):
                room = {k: N[k] - out[k] for k in out if N[k] > out[k]}
                free = sum(room.values())
                if free:
                    for k, v in hamilton({k: min(over, free) * r / free for k, r in room.items()}, int(min(over, free))).items():
                        out[k] += v
        return out

    # ---- frame -------------------------------------------------------------
    def _prepared(self, n, by, where, drop_nulls):
        """Frame rows with ``__in`` (eligible) and ``__n`` (wanted in the group)."""
        keys = self._groups(by)
        df = self.sample.data
        p = predicate(where)
        df = df.withColumn("__in", F.coalesce(p, F.lit(False)) if p is not None else F.lit(True))
        if drop_nulls and keys:
            df = df.dropna(subset=keys)
        if isinstance(n, dict):
            if not keys:
                raise MethodError("sizes by group need strata or by", param="n")
            types = dict(df.dtypes)
            rows = [(*(k if isinstance(k, tuple) else (k,)), int(v)) for k, v in n.items()]
            if any(len(r) != len(keys) + 1 for r in rows):
                raise DimensionError("keys of n must name the groups", param="n")
            table = df.sparkSession.createDataFrame(rows, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "__n int"]))
            df = equal(df, table, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
        else:
            df = df.withColumn("__n", F.lit(int(n)))
        return df, keys

    def _identity(self, df: DataFrame, seed: int, salt: str) -> Column:
        cols = [c for c in self.sample.data.columns if not c.startswith("__")]
        return F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(f"`{c}`") for c in cols])

    def _order(self, order_by, order_type: str, seed: int) -> list[Column]:
        if order_type == "random" or order_by is None:
            return [F.col("__u")]
        cols = [order_by] if isinstance(order_by, str) else list(order_by)
        return [*[F.desc(c) if order_type == "descending" else F.asc(c) for c in cols], F.col("__u")]

    def _finish(self, df: DataFrame, where, prob_name, wgt_name, hit_name, prob: Column, hits: Column):
        d = self.sample.design
        prob_name, wgt_name, hit_name = prob_name or "survey_prob_selection", wgt_name or "survey_sample_weight", hit_name or "survey_number_of_hits"
        chosen = F.col("__in") & (hits > 0)
        before = F.col(d.prob).cast("double") if d.prob else F.lit(1.0)
        full = before * prob
        df = df.withColumns({prob_name: F.when(chosen, full), wgt_name: F.when(chosen, 1 / full), hit_name: F.when(chosen, hits.cast("long"))})
        if where is None:
            df = df.where(F.col(hit_name).isNotNull())
        keep = [c for c in dict.fromkeys([*self.sample.data.columns, prob_name, wgt_name, hit_name])]
        return self.sample._with(df.select(*[f"`{c}`" for c in keep]), d.update(prob=prob_name, wgt=wgt_name, hit=hit_name))

    # ---- simple random sampling --------------------------------------------
    def srs(self, n, *, by=None, where=None, wr=False, order_by=None, order_type="ascending", prob_name=None, wgt_name=None, hit_name=None, rstate=None, drop_nulls=False):
        """``n`` rows per group, without or with replacement."""
        seed = int(rstate or 0)
        df, keys = self._prepared(n, by, where, drop_nulls)
        df = df.withColumn("__u", self._identity(df, seed, "srs"))
        sizes = df.groupBy(*keys).agg(F.count_if("__in").alias("__pop"))
        df = equal(df, sizes, keys)
        df = running(df, [*keys, "__in"], [F.col("__u"), *[F.col(f"`{c}`") for c in self.sample.data.columns[:1]]], F.lit(1), "__k")
        N, m = F.col("__pop"), F.col("__n")
        if not wr:
            return self._finish(df, where, prob_name, wgt_name, hit_name, F.least(m, N) / N, (F.col("__k") <= m).cast("int"))
        # each of n draws picks a place; a row's hits are the draws on its place
        df = df.withColumn("__k", F.col("__k") - 1)
        draws = equal(sizes, df.groupBy(*keys).agg(F.max("__n").alias("__n")), keys).where("__n > 0 and __pop > 0")
        places = draws.select(*keys, "__pop", F.explode(F.sequence(F.lit(1), "__n")).alias("__d"))
        place = F.pmod(F.xxhash64(F.lit(seed), F.lit("wr"), "__d", *keys), F.col("__pop"))
        hits = places.select(*keys, place.alias("__k"), F.lit(True).alias("__in")).groupBy(*keys, "__k", "__in").agg(F.count("*").alias("__hits"))
        df = equal(df, hits, [*keys, "__k", "__in"], "left")
        return self._finish(df, where, prob_name, wgt_name, hit_name, 1 - F.pow(1 - 1 / N, m), F.coalesce("__hits", F.lit(0)))

    # ---- probability proportional to size ----------------------------------
    def _sized(self, n, by, where, threshold, drop_nulls, seed, wr=False):
        """Rows with ``__x`` (size), ``__c`` (certainty) and what is left for the others.

        Certainties are found in passes: against the totals at a pass's start, rows
        with ``n_left * x / total`` of at least the threshold are certain.
        """
        mos = self.sample.design.mos
        if not mos:
            raise MethodError("the design has no measure of size", where="pps", hint="Design(mos=...)")
        df, keys = self._prepared(n, by, where, drop_nulls)
        bad = df.where(F.col("__in") & (F.col(mos).isNull() | (F.col(mos) <= 0))).limit(1).count()
        if bad:
            raise MethodError("sizes must be positive", param="mos")
        df = df.withColumns({"__x": F.col(mos).cast("double"), "__u": self._identity(df, seed, "pps"), "__c": F.lit(False)})
        while True:
            free = F.col("__in") & ~F.col("__c")
            left = df.groupBy(*keys).agg(
                F.coalesce(F.sum(F.when(free, F.col("__x"))), F.lit(0.0)).alias("__total"),
                (F.max("__n") - F.count_if(F.col("__in") & F.col("__c"))).alias("__left"),
                F.count_if("__in").alias("__pop"),
            )
            now = equal(df, left, keys)
            take = F.col("__in") & ~F.col("__c") & (F.col("__left") > 0) & (F.col("__left") * F.col("__x") / F.col("__total") >= threshold - 1e-12)
            if wr:
                return now, keys
            if not now.where(take).limit(1).count():
                return now, keys
            df = now.withColumn("__c", F.col("__c") | take).drop("__total", "__left", "__pop")

    def pps_sys(self, n, *, certainty_threshold=1.0, by=None, where=None, order_by=None, order_type="ascending", prob_name=None, wgt_name=None, hit_name=None, rstate=None, drop_nulls=False):
        """Systematic: a random start, then equal steps along the cumulated sizes."""
        seed = int(rstate or 0)
        df, keys = self._sized(n, by, where, certainty_threshold, drop_nulls, seed)
        free = F.col("__in") & ~F.col("__c")
        size = F.when(free, F.col("__x")).otherwise(0.0)
        step = F.try_divide(F.col("__total"), F.col("__left"))
        start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), *keys), F.lit(1 << 30)) / float(1 << 30)
        df = running(df, keys, self._order(order_by, order_type, seed), size, "__upto", before="__from")
        at = lambda c: F.greatest(F.ceil(c / step - start), F.lit(0))  # noqa: E731  grid points below c
        grid = F.when(free & (F.col("__left") > 0), at(F.col("__upto")) - at(F.col("__from"))).otherwise(0)
        hits = F.when(F.col("__c"), 1).otherwise(grid)
        prob = F.when(F.col("__c"), 1.0).otherwise(F.least(F.col("__left") * F.col("__x") / F.col("__total"), F.lit(1.0)))
        df = df.withColumns({"__h": hits, "__p": prob})
        return self._finish(df, where, prob_name, wgt_name, hit_name, F.col("__p"), F.col("__h"))

    def pps_wr(self, n, *, certainty_threshold=1.0, by=None, where=None, prob_name=None, wgt_name=None, hit_name=None, rstate=None, drop_nulls=False):
        """With replacement: every draw falls on the cumulated sizes anew.

        A group's total is cut into as many bins as it has draws.  Draws meet the rows
        that reach into their bin, so few rows are looked at whatever the sizes are.
        """
        seed = int(rstate or 0)
        df, keys = self._sized(n, by, where, certainty_threshold, drop_nulls, seed, wr=True)
        free = F.col("__in") & (F.col("__left") > 0)
        df = running(df, keys, [F.col("__u")], F.when(free, F.col("__x")).otherwise(0.0), "__upto", before="__from", row="__row")
        groups = df.where(free).groupBy(*keys).agg(F.max("__left").alias("__m"), F.max("__upto").alias("__top"))
        slot = lambda c: F.least(F.floor(F.col(c) / F.col("__top") * F.col("__m")), F.col("__m") - 1)
        at = F.pmod(F.xxhash64(F.lit(seed), F.lit("wr"), "__d", *keys), F.lit(1 << 52)) / float(1 << 52) * F.col("__top")
        draws = groups.withColumn("__d", F.explode(F.sequence(F.lit(1).cast("long"), "__m"))).withColumn("__at", at).select(*keys, "__at", slot("__at").alias("__b"))
        rows = equal(df.where(free), groups, keys).select(*keys, "__row", "__from", "__upto", F.explode(F.sequence(slot("__from"), slot("__upto"))).alias("__b"))
        hits = equal(rows, draws, [*keys, "__b"]).where("__from <= __at and __at < __upto").groupBy("__row").agg(F.count("*").alias("__h"))
        df = df.join(hits, "__row", "left")
        prob = 1 - F.pow(1 - F.col("__x") / F.col("__total"), F.col("__left"))
        return self._finish(df, where, prob_name, wgt_name, hit_name, prob, F.when(free, F.coalesce("__h", F.lit(0))).otherwise(0))

    def pps_brewer(self, n, *, certainty_threshold=1.0, by=None, where=None, prob_name=None, wgt_name=None, hit_name=None, rstate=None, drop_nulls=False):
        return self._drawn("brewer", n, certainty_threshold, by, where, prob_name, wgt_name, hit_name, rstate, drop_nulls)

    def pps_murphy(self, n=2, *, certainty_threshold=1.0, by=None, where=None, prob_name=None, wgt_name=None, hit_name=None, rstate=None, drop_nulls=False):
        sizes = n.values() if isinstance(n, dict) else [n]
        if any(v != 2 for v in sizes):
            raise MethodError("this method draws two units", param="n")
        return self._drawn("murphy", n, certainty_threshold, by, where, prob_name, wgt_name, hit_name, rstate, drop_nulls)

    def pps_rs(self, n, *, certainty_threshold=1.0, by=None, where=None, prob_name=None, wgt_name=None, hit_name=None, rstate=None, drop_nulls=False):
        """Rao-Sampford: rejective, inclusion probabilities exactly proportional to size."""
        return self._drawn("rs", n, certainty_threshold, by, where, prob_name, wgt_name, hit_name, rstate, drop_nulls)

    def _drawn(self, how, n, threshold, by, where, prob_name, wgt_name, hit_name, rstate, drop_nulls):
        """Sequential draws inside a group; only sizes and row keys go to Python."""
        seed = int(rstate or 0)
        df, keys = self._sized(n, by, where, threshold, drop_nulls, seed)
        free = df.where(F.col("__in") & ~F.col("__c") & (F.col("__left") > 0)).select(*keys, "__u", "__x", "__left")
        tag = F.xxhash64(F.lit(seed), F.lit(how), *keys) if keys else F.lit(seed)

        def draw(pdf):
            pdf = pdf.sort_values(["__u", "__x"])
            rng = np.random.default_rng(abs(int(pdf["__g"].iloc[0])))
            hits, prob = DRAWS[how](pdf["__x"].to_numpy(float), int(pdf["__left"].iloc[0]), rng)
            return pdf[["__u"]].assign(__h=hits.astype("int64"), __p=prob.astype(float)).drop_duplicates("__u")

        got = free.withColumn("__g", tag).groupBy("__g", *keys).applyInPandas(draw, "__u bigint, __h bigint, __p double")
        both = df.join(got, "__u", "left")
        hits = F.when(F.col("__c"), 1).otherwise(F.coalesce("__h", F.lit(0)))
        prob = F.when(F.col("__c"), 1.0).otherwise(F.col("__p"))
        return self._finish(both, where, prob_name, wgt_name, hit_name, prob, hits)

    # ---- stages ------------------------------------------------------------
    def add_stage(self, next_stage, *, prob_name=None, wgt_name=None):
        """Join a sample of a later stage to this one's units; probabilities multiply.

        Every unit of the later stage must belong to a PSU selected here.
        """
        d, e = self.sample.design, next_stage.design
        keys = [*d.strata, *d.psus]
        if not d.psus or not d.prob:
            raise DimensionError("the first stage needs a PSU and selection probabilities", where="add_stage")
        if lost := [k for k in keys if k not in next_stage.data.columns]:
            raise DimensionError(f"the next stage lacks {', '.join(lost)}", where="add_stage")
        prob_name, wgt_name = prob_name or "survey_prob_selection", wgt_name or "survey_sample_weight"
        first = self.sample.data.groupBy(*keys).agg(F.max(d.prob).alias("__p1"))
        later = next_stage.data
        if equal(later.select(*keys).distinct(), first, keys, "left").where("__p1 is null").limit(1).count():
            raise DimensionError("the next stage has units of PSUs that were not selected", where="add_stage")
        both = equal(later, first, keys)
        full = F.col("__p1") * (F.col(e.prob).cast("double") if e.prob else F.lit(1.0))
        both = both.withColumns({"__full": full}).drop("__p1")
        both = both.withColumns({prob_name: F.col("__full"), wgt_name: 1 / F.col("__full")}).drop("__full")
        return next_stage._with(both, e.update(stratum=d.stratum, psu=d.psu, ssu=e.ssu or (e.psu if e.psu != d.psu else None), prob=prob_name, wgt=wgt_name, pop_size=e.pop_size or d.pop_size))


def draw_brewer(x: np.ndarray, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """One unit after another, with Brewer's working probabilities."""
    N = len(x)
    if n >= N:
        return np.ones(N), np.ones(N)
    pi = n * x / x.sum()
    chosen = np.zeros(N, bool)
    for k in range(n):
        # what is left to draw, among the units left
        rest = n - pi[chosen].sum()
        q = np.where(chosen, 0.0, pi * (rest - pi) / np.maximum(rest - pi * (n - k), 1e-12))
        q = np.maximum(q, 0)
        chosen[rng.choice(N, p=q / q.sum())] = True
    return chosen.astype(float), np.minimum(pi, 1.0)


def draw_murphy(x: np.ndarray, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two successive draws without replacement; exact inclusion probabilities."""
    N = len(x)
    if n >= N:
        return np.ones(N), np.ones(N)
    p = x / x.sum()
    out = np.zeros(N)
    first = rng.choice(N, p=p)
    out[first] = 1
    if n > 1:
        q = np.where(out > 0, 0, p)
        out[rng.choice(N, p=q / q.sum())] = 1
    odds = p / np.maximum(1 - p, 1e-12)
    return out, p * (1 + odds.sum() - odds) if n > 1 else p


def draw_rs(x: np.ndarray, n: int, rng, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    N = len(x)
    if n >= N:
        return np.ones(N), np.ones(N)
    p = x / x.sum()
    pi = n * p
    q = p / np.maximum(1 - pi, 1e-12)
    q = q / q.sum()
    for _ in range(most):
        got = np.concatenate([[rng.choice(N, p=p)], rng.choice(N, n - 1, p=q)])
        if len(set(got.tolist())) == n:
            out = np.zeros(N)
            out[got] = 1
            return out, np.minimum(pi, 1.0)
    raise MethodError("no sample was accepted", where="pps_rs", hint="sizes are too unequal for n; use pps_sys or pps_brewer")


DRAWS = {"brewer": draw_brewer, "murphy": draw_murphy, "rs": draw_rs}
