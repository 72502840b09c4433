"""Summaries of columns, chosen by measurement type; one wide aggregation per kind."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.metadata import _BY_TYPE


@dataclass
class DescribeResult:
    items: list[dict] = field(default_factory=list)

    def to_dicts(self) -> list[dict]:
        return self.items

    def __getitem__(self, name: str) -> dict:
        return next(x for x in self.items if x["name"] == name)


def frequencies(df: DataFrame, name: str, top_k: int | None, weight: Column) -> DataFrame:
    """(value, n, weight, share) by weight; the share is of all levels, listed or not."""
    out = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    total = df.agg(F.sum(weight).alias("__t"))
    out = out.crossJoin(F.broadcast(total)).select("value", "n", "weight", F.try_divide("weight", "__t").alias("share"))
    out = out.orderBy(F.desc("weight"), F.asc_nulls_last("value"))
    return out.limit(top_k) if top_k else out


def weighted_summary(df: DataFrame, name: str, weight: Column, percentiles) -> dict:
    """n, mean, var, std, min, max, sum and quantiles under weights.

    The variance is n / (n - 1) times the weighted one; a quantile is the first
    value whose cumulative weight reaches its share.
    """
    rows = df.select(F.col(name).cast("double").alias("x"), weight.cast("double").alias("w")).where("x is not null and w > 0")
    n, sw, mean, lo, hi, total = rows.agg(F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("x")) / F.sum("w"), F.min("x"), F.max("x"), F.sum(F.col("w") * F.col("x"))).first()
    if not n:
        return {"n": 0}
    spread = rows.agg(F.sum(F.col("w") * F.pow(F.col("x") - mean, 2))).first()[0] / sw
    var = n / (n - 1) * spread if n > 1 else None
    cut = rows.groupBy("x").agg(F.sum("w").alias("w")).repartitionByRange("x").withColumn("part", F.spark_partition_id()).persist()
    parts = cut.groupBy("part").agg(F.sum("w").alias("pw"))
    offsets = parts.select("part", F.coalesce(F.sum("pw").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("o"))
    cum = F.col("o") + F.sum("w").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    cdf = cut.join(offsets, "part").select("x", cum.alias("c"))
    qs = cdf.agg(*[F.min(F.when(F.col("c") >= p * sw - 1e-9 * sw, F.col("x"))).alias(f"p{p}") for p in percentiles]).first()
    cut.unpersist()
    return {"n": n, "mean": mean, "var": var, "std": var**0.5 if var is not None else None, "min": lo, "max": hi, "sum": total, **{f"p{round(p * 100)}": v for p, v in zip(percentiles, qs)}}


def describe(sample, columns=None, *, weighted=False, weight_col=None, drop_nulls=True, top_k=10, percentiles=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DescribeResult:
    df = sample.data
    columns = [columns] if isinstance(columns, str) else list(columns or df.columns)
    types = dict(df.dtypes)
    kind = {c: (v.type if (v := sample.meta.get(c)) and v.type else _BY_TYPE.get(types[c], "string")) for c in columns}
    weight = F.col(weight_col or sample.require_weight("describe")) if weighted else F.lit(1.0)
    aggs: list[Column] = [F.count("*").alias("__all")]
    for c in columns:
        x = F.col(c)
        aggs.append(F.count(x).alias(f"{c}|n"))
        if kind[c] in ("continuous", "discrete") and not weighted:
            aggs += [f(x).alias(f"{c}|{k}") for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("var", F.var_samp), ("min", F.min), ("max", F.max), ("sum", F.sum))]
            aggs += [F.percentile(x, F.lit(float(p))).alias(f"{c}|p{round(p * 100)}") for p in percentiles]
        elif kind[c] == "boolean":
            aggs += [F.coalesce(F.sum(F.when(x.cast("boolean"), weight)), F.lit(0.0)).alias(f"{c}|true"), F.coalesce(F.sum(F.when(~x.cast("boolean"), weight)), F.lit(0.0)).alias(f"{c}|false")]
        elif kind[c] == "datetime":
            aggs += [F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
        elif kind[c] in ("string", "nominal", "ordinal"):
            aggs.append(F.count_distinct(x).alias(f"{c}|n_unique"))
            if kind[c] == "string":
                size = F.char_length(x.cast("string"))
                aggs += [f(size).alias(f"{c}|len_{k}") for k, f in (("min", F.min), ("median", F.median), ("mean", F.avg), ("max", F.max))]
    row = df.agg(*aggs).first()
    items = []
    for c in columns:
        out = {"name": c, "type": kind[c], "n_missing": row["__all"] - row[f"{c}|n"]}
        out |= {k.split("|", 1)[1]: row[k] for k in row.asDict() if k.startswith(f"{c}|")}
        if weighted and kind[c] in ("continuous", "discrete"):
            out |= weighted_summary(df, c, weight, percentiles)
        if kind[c] == "boolean" and (n := out["true"] + out["false"]):
            out |= {"share_true": out["true"] / n, "share_false": out["false"] / n}
        if kind[c] in ("discrete", "nominal", "ordinal", "string"):
            rows = df.where(F.col(c).isNotNull()) if drop_nulls else df
            top = [r.asDict() for r in frequencies(rows, c, top_k, weight).collect()]
            out |= {"top": top, "mode": top[0]["value"] if top else None}
            if "n_unique" in out:
                out["n_levels"], out["truncated"] = out["n_unique"], out["n_unique"] > len(top)
        items.append(out)
    return DescribeResult(items)
