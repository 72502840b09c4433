"""Running design-based means over a stream of microdata.

The sums an estimate needs add up over batches, so a stream is aggregated to the
table of sampling units and every trigger gives estimates from that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.design import Design


def unit_stream(stream: DataFrame, design: Design, y: str) -> DataFrame:
    """Sums per stratum and PSU of a streaming DataFrame, for complete output mode."""
    w = F.col(design.wgt).cast("double") if design.wgt else F.lit(1.0)
    ok = F.col(y).isNotNull()
    return stream.groupBy(*design.strata, *design.psus).agg(
        F.sum(F.when(ok, w).otherwise(0.0)).alias("sw"), F.sum(F.when(ok, w * F.col(y)).otherwise(0.0)).alias("swy"), F.count_if(ok).alias("n")
    )


def mean_of_units(units: DataFrame, design: Design) -> DataFrame:
    """(est, se, df, n) from a table of unit sums."""
    t = units.agg(F.sum("sw").alias("w"), F.sum("swy").alias("wy"), F.sum("n").alias("n"))
    z = units.crossJoin(F.broadcast(t)).withColumn("z", (F.col("swy") - F.col("wy") / F.col("w") * F.col("sw")) / F.col("w"))
    h = z.groupBy(*design.strata).agg(F.count("*").alias("m"), F.var_samp("z").alias("v"))
    v = h.agg(F.sum(F.when(F.col("m") > 1, F.col("m") * F.col("v")).otherwise(0.0)).alias("var"), F.sum(F.col("m") - 1).alias("df"))
    return t.crossJoin(v).select((F.col("wy") / F.col("w")).alias("est"), F.sqrt("var").alias("se"), "df", "n")


def watch_mean(stream: DataFrame, design: Design, y: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that hands (est, se, df, n) to ``sink`` after every trigger."""
    each = lambda units, epoch: sink(mean_of_units(units, design), epoch)
    out = unit_stream(stream, design, y).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
