"""Row numbers per key without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import cut_lineage


def bucketed_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """0-based rank per ``keys`` by ``(bucket, order)``.

    ``bucket`` must be non-decreasing in ``order`` and bound the rows it holds (an
    image row, a block of consecutive ids).  Rows are ranked inside their bucket;
    bucket sizes are prefix-summed on the aggregated counts only.  Both sides are
    hashed on ``(keys, bucket)``.
    """
    rows = df.withColumn("__b", bucket)
    inner = Window.partitionBy(*keys, "__b").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
        .select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    return (
        rows.withColumn("__r", F.row_number().over(inner) - 1)
        .join(offsets, [*keys, "__b"])
        .withColumn(name, (F.col("__off") + F.col("__r")).cast("long"))
        .drop("__b", "__off", "__r")
    )


def range_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """0-based rank per ``keys`` for orders with no natural bucket (text ids).

    Range-partitions and sorts once, checkpoints so partition numbers cannot move
    when an executor is lost, then adds per-partition offsets.
    """
    placed = (
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed)
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__pid").agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
        .select(*keys, "__pid", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    )
    return (
        placed.join(offsets, [*keys, "__pid"])
        .withColumn(name, (F.col("__off") + F.col("__pos") - F.col("__first")).cast("long"))
        .drop("__pid", "__pos", "__first", "__off")
    )
