"""Size checks that decide whether a side may be broadcast, and over how many tasks rows are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.sources.folders import stored

BROADCAST_ROWS = 100_000
#: Rows of a task that fits: fewer are not worth one, more do not fit beside the statistics of the nodes.
LEAST_ROWS, MOST_ROWS = 2_000, 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted rows allow it, else leave the join to Spark.

    For narrow, already aggregated sides: they are written to the shared folder, so that they are computed once,
    outlive a lost executor and leave no cached blocks behind.
    """
    kept = stored(df, "side")
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def fitting_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for a table that a fit reads many times: as many as can run for few rows, of a bounded size for many."""
    return max(min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS), 1)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows, computed once and dealt by ``key`` over ``fitting_tasks``, however few files they are read from."""
    kept = stored(df, "rows")
    return stored(kept.repartition(fitting_tasks(df.sparkSession, kept.count()), key), "dealt")
