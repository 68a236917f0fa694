"""Numbers in an order over more rows than a task should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanline.operators.sizes import broadcast_if_small
from loanline.sources.folders import cut_lineage


def number_in_order(df: DataFrame, group: str, turn: str, number: str = "number") -> DataFrame:
    """Number the rows of each group from 1 without gathering a group in one task.

    Rows are range-partitioned and kept, numbered inside a range, and moved on by the row
    counts of the ranges before it.
    """
    ranged = cut_lineage(df.repartitionByRange(group, turn).withColumn("slice", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(group, "slice").orderBy(turn))
    joined = ranged.withColumn(number, inside).join(broadcast_if_small(starts), [group, "slice"])
    return joined.withColumn(number, F.col(number) + F.col("start")).drop("slice", "start")
