"""Ranks over whole tables without a single task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.session import checkpointed


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with ``name``, its place from 1 in the order, which should have no ties.

    The rows are range-partitioned and numbered inside their partition; the partitions' sizes, one row each, are summed up
    and added. The checkpoint makes both passes see the same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = checkpointed(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_id", "_part", "_at", "_before")
