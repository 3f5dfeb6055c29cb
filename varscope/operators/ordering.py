"""Dense positions within a group that need not fit one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varscope.session import fits_broadcast, materialize


def with_ordinal(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ord"
) -> DataFrame:
    """Add ``name`` = 1, 2, 3 ... within ``group`` by ``order``.

    A plain ``row_number`` would sort a whole group in one task. Here the rows are range
    partitioned, so a large group spreads over many tasks. The rows are stored first:
    range partitioning samples its input, and would else compute it twice. The sorted
    slices are written once, which freezes them; counting rows per (group, slice) then
    gives each slice its offset. That count table has at most one row per group plus one
    per slice; counted to be small, it is broadcast, and the rows are not shuffled again.
    """
    slices = materialize(
        materialize(df).repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        slices.groupBy(*group, "_slice")
        .agg(F.count("*").alias("_rows"), F.min("_slot").alias("_start"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    return (
        slices.join(offsets, [*group, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_slot") - F.col("_start") + 1)
        .drop("_slice", "_slot", "_start", "_before")
    )
