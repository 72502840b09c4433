"""Running sums in which no group is put in order by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.plans.units import equal, grouped


def running(df: DataFrame, keys: list[str], order: list[Column], weight: Column, upto: str, *, before: str | None = None, total: str | None = None, row: str | None = None) -> DataFrame:
    """``df`` with the sum of ``weight`` in order within its group, up to and with each row.

    ``before`` names the sum without the row itself, equal to the last bit to the row before's
    ``upto``; ``total`` the group's sum; ``row`` a number of the row that stays the same
    wherever the result is used.  Rows are range-partitioned by group and order and summed
    inside partitions; a partition starts from the sum of those before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__add", weight).repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    named = {"__part": F.spark_partition_id()} | ({row: F.monotonically_increasing_id()} if row else {})
    ranged = ranged.withColumns(named).persist()  # read twice, with the same bounds
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("__add").alias("__sum"))
    w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "__part", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__start"))
    out = equal(ranged, starts, [*keys, "__part"])
    if total:
        out = equal(out, grouped(parts, keys, [F.sum("__sum").alias(total)]), keys)
    w = Window.partitionBy(*keys, "__part").orderBy(*order)
    sums = {upto: F.col("__start") + F.sum("__add").over(w.rowsBetween(Window.unboundedPreceding, 0))}
    if before:
        sums[before] = F.col("__start") + F.coalesce(F.sum("__add").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumns(sums).drop("__add", "__part", "__start")
