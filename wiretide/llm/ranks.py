"""Places of rows in an order over all partitions, without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiretide.llm.common import stored

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def held(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The same columns, from a generator: what a projection computes is computed anew at each use, its rows are not."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def in_order(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows dealt to partitions by ranges of ``keys`` and written in that order, with ``_at``, which rises along it.

    Equal rows keep the order in which they were read and may lie in several partitions.
    """
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    return stored(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, *group: str) -> DataFrame:
    """Rows of ``in_order`` with ``_place`` (from 0) among those of their ``group``, and its ``_size``.

    The group comes first in the order and is not null. What is summed up has a row per group and partition.
    """
    rows = rows.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    runs = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", *group, "_first", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"),
                       F.sum("_n").over(Window.partitionBy(*group)).alias("_size"))
    return (rows.join(runs, ["_part", *group]).withColumn("_place", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_part", "_at", "_first", "_before"))
