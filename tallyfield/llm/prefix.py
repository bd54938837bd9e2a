"""Global prefix sums from per-partition totals, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import Stored, store

PART = "_part"


def range_parts(df: DataFrame, order: Sequence[Column]) -> Stored:
    """Rows in range partitions of ``order``; the stored number ``_part`` keeps each row's place.

    A unique number breaks ties, so that equal rows can be split between partitions.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(parts, *order, F.col("_tie"))
    return store(ranged.withColumn(PART, F.spark_partition_id()), "ranges")


def prefix_sums(parts: Stored, order: Sequence[Column], value: str) -> DataFrame:
    """Adds ``_end`` (sum of ``value`` up to and with the row) and ``_position`` (from 1).

    One row per partition is summed up ahead of the rows; its size is the number of
    partitions. Within a partition the sums run in the given order.
    """
    along = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.df.groupBy(PART).agg(F.sum(value).alias("_sum"), F.count("*").alias("_rows"))
    before = totals.select(
        PART,
        F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_rows_before"),
    )
    within = Window.partitionBy(PART).orderBy(*order, F.col("_tie"))
    return (
        parts.df.join(F.broadcast(before), PART)
        .withColumn("_end", F.col("_sum_before") + F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_position", F.col("_rows_before") + F.row_number().over(within))
        .drop("_sum_before", "_rows_before")
    )
