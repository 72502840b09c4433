"""Linearized variances from sums over sampling units.

Everything is wide: one row per unit (a PSU, an SSU, or a row where there is no
PSU) with the sums each estimate needs, then one row per domain with totals, then
one row per domain and stratum.  Units without a row in a domain are zeros; they
enter by their number, so the domain's table never has to be filled up.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.errors import SingletonError


@dataclass
class Frame:
    """A sample prepared for estimation: its rows, design keys and weight column names."""

    data: DataFrame
    by: list[str]
    strata: list[str]
    psus: list[str]
    ssus: list[str]
    fpc_psu: str | None = None
    fpc_ssu: str | None = None
    singleton: str | None = None  # skip, scale or center: how lone PSUs are treated
    lone: str | None = None  # boolean column marking rows of lone PSUs that were set aside


def grouped(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def equal(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may hold nulls; without keys ``b`` is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    renamed = b.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in b.columns])
    on = None
    for k in keys:
        one = a[k].eqNullSafe(renamed[f"__{k}"])
        on = one if on is None else on & one
    return a.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def unit_sums(frame: Frame, sums: dict[str, Column]) -> DataFrame:
    """One row per unit and domain with ``sums``; rows are units if there is no PSU."""
    extra = {}
    if frame.fpc_psu:
        extra["__N"] = F.col(frame.fpc_psu).cast("double")
    if frame.fpc_ssu:
        extra["__M"] = F.col(frame.fpc_ssu).cast("double")
    keys = [*frame.by, *frame.strata, *frame.psus, *frame.ssus]
    if not frame.psus:
        return frame.data.select(*keys, *[c.alias(k) for k, c in {**sums, **extra}.items()])
    aggs = [F.sum(c).alias(k) for k, c in sums.items()] + [F.max(c).alias(k) for k, c in extra.items()]
    return grouped(frame.data, keys, aggs)


def sizes(units: DataFrame, frame: Frame) -> DataFrame:
    """One row per stratum: its number of PSUs ``m`` over the whole design, and the FPC, below zero if the population is smaller than the sample."""
    if frame.psus:
        keys = [*frame.strata, *frame.psus]
        one = units.groupBy(*keys).agg(*([F.max("__N").alias("__N")] if frame.fpc_psu else [F.lit(1).alias("__one")]))
    else:
        one = units
    aggs = [F.count(F.lit(1)).alias("m")] + ([F.max("__N").alias("__N")] if frame.fpc_psu else [])
    out = grouped(one, frame.strata, aggs)
    fpc = F.least(F.lit(1.0), (F.col("__N") - F.col("m")) / F.col("__N")) if frame.fpc_psu else F.lit(1.0)
    return out.withColumn("fpc", fpc).drop("__N")


def root(variance: float) -> float:
    """A standard error; NaN for a negative variance, of a population smaller than its sample."""
    return math.sqrt(variance) if variance >= 0 else math.nan


def check_lone(per_stratum: DataFrame, frame: Frame) -> None:
    """Lone-PSU strata are an error unless they were handled."""
    if frame.singleton or not frame.strata:
        return
    lone = per_stratum.where("m = 1").limit(5).collect()
    if lone:
        shown = ", ".join(str(tuple(r[k] for k in frame.strata)) for r in lone)
        raise SingletonError(f"strata with a single PSU: {shown}", where="estimation", hint="handle them first, for example sample.singleton.center()")


def zeros_too(k: Column, v: Column, s: Column, m: Column) -> Column:
    """Sum of squares about the mean of ``m`` values, of which ``k`` are given by variance and sum, the rest 0."""
    return F.when(k > 0, (k - 1) * F.coalesce(v, F.lit(0.0)) + s * s * (1 / k - 1 / m)).otherwise(0.0)


def variances(units: DataFrame, frame: Frame, totals: DataFrame, scores: dict[str, Callable[[], Column]], active: dict[str, str], cross: list[tuple[str, str]] = ()) -> DataFrame:
    """One row per domain: for each score its variance ``var_<name>`` and degrees of freedom ``df_<name>``.

    ``totals`` has a row per domain and the columns the scores use; ``active``
    names for each score the unit column that is positive if the unit takes part.
    ``cross`` pairs of scores get a covariance ``cov_<a>_<b>``.
    """
    keys = [*frame.by, *frame.strata]
    design = sizes(units, frame)
    check_lone(design, frame)
    scored = equal(units, totals, frame.by)
    names = list(scores)
    scored = scored.select(*keys, *frame.psus, *frame.ssus, *(["__M"] if frame.fpc_ssu else []), *[F.coalesce(scores[n](), F.lit(0.0)).alias(f"z_{n}") for n in names], *[F.col(c).alias(f"a_{n}") for n, c in active.items()])
    within = None
    if frame.ssus and frame.fpc_psu:
        ssu_count = units.groupBy(*frame.strata, *frame.psus).agg(F.countDistinct(F.struct(*frame.ssus)).alias("mm"), F.max("__M").alias("__M") if frame.fpc_ssu else F.lit(None).cast("double").alias("__M"))
        inner = [F.count(F.lit(1)).alias("k")] + [f(F.col(f"z_{n}")).alias(f"{p}_{n}") for n in names for p, f in (("v", F.var_samp), ("s", F.sum))]
        inner += [F.max(f"a_{n}").alias(f"a_{n}") for n in active]
        psu = scored.groupBy(*keys, *frame.psus).agg(*inner)
        psu = equal(psu, ssu_count, [*frame.strata, *frame.psus])
        f2 = F.least(F.lit(1.0), (F.col("__M") - F.col("mm")) / F.col("__M")) if frame.fpc_ssu else F.lit(1.0)
        spread = lambda n: F.when(F.col("mm") > 1, f2 * F.col("mm") / (F.col("mm") - 1) * zeros_too(F.col("k"), F.col(f"v_{n}"), F.col(f"s_{n}"), F.col("mm"))).otherwise(0.0)
        scored = psu.select(*keys, *frame.psus, *[F.col(f"s_{n}").alias(f"z_{n}") for n in names], *[F.col(f"a_{n}") for n in active], *[spread(n).alias(f"w_{n}") for n in names])
        within = True
    elif frame.ssus:
        scored = scored.groupBy(*keys, *frame.psus).agg(*[F.sum(f"z_{n}").alias(f"z_{n}") for n in names], *[F.max(f"a_{n}").alias(f"a_{n}") for n in active])
    aggs = [F.count(F.lit(1)).alias("k")]
    for n in names:
        aggs += [F.var_samp(f"z_{n}").alias(f"v_{n}"), F.sum(f"z_{n}").alias(f"s_{n}"), F.count_if(F.col(f"a_{n}") > 0).alias(f"p_{n}")]
        if within:
            aggs.append(F.sum(f"w_{n}").alias(f"w_{n}"))
    for a, b in cross:
        aggs.append(F.covar_samp(f"z_{a}", f"z_{b}").alias(f"c_{a}_{b}"))
    strata = equal(grouped(scored, keys, aggs), design, frame.strata)
    k, m, fpc = F.col("k"), F.col("m"), F.col("fpc")
    if frame.singleton == "center":
        # deviations of lone units from the mean of all units of the design
        count = design.agg(F.sum("m").alias("all_m"))
        mean = grouped(scored, frame.by, [F.sum(f"z_{n}").alias(f"g_{n}") for n in names])
        strata = equal(strata, mean, frame.by).crossJoin(F.broadcast(count))
    out = []
    for n in names:
        between = F.when(m > 1, fpc * m / (m - 1) * zeros_too(k, F.col(f"v_{n}"), F.col(f"s_{n}"), m)).otherwise(0.0)
        if frame.singleton == "center":
            between = F.when(m == 1, fpc * F.pow(F.col(f"s_{n}") - F.col(f"g_{n}") / F.col("all_m"), 2)).otherwise(between)
        if within:
            between = between + F.when(fpc < 1, (1 - fpc) * F.col(f"w_{n}")).otherwise(0.0)
        out.append(F.sum(between).alias(f"var_{n}"))
        groups = F.count_if(F.col(f"p_{n}") > 0) if frame.strata else F.lit(1)
        out.append(F.greatest(F.sum(f"p_{n}") - groups, F.lit(0)).cast("long").alias(f"df_{n}"))
        out.append(F.sum(f"p_{n}").alias(f"psus_{n}"))
        out.append((F.count_if(F.col(f"p_{n}") > 0) if frame.strata else F.lit(0).cast("long")).alias(f"strata_{n}"))
    for a, b in cross:
        sa, sb = F.col(f"s_{a}"), F.col(f"s_{b}")
        both = F.when(k > 0, (k - 1) * F.coalesce(F.col(f"c_{a}_{b}"), F.lit(0.0)) + sa * sb * (1 / k - 1 / m)).otherwise(0.0)
        out.append(F.sum(F.when(m > 1, fpc * m / (m - 1) * both).otherwise(0.0)).alias(f"cov_{a}_{b}"))
    return grouped(strata, frame.by, out)
