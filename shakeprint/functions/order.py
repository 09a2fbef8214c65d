"""Numbers in a total order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialise

_LOW = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`, 1 and up in that order. Rows are range-partitioned by it, each partition numbers its own, and
    starts where those before it end: what one task sums up is a row a partition. Equal rows are numbered as they come."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    return stored.withColumn("_part", part).join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_at").bitwiseAND(_LOW) + 1).cast("long")).drop("_at", "_part", "_start")
