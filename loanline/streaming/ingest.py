"""Incremental ingest as micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loanline.operators.incremental import new_records
from loanline.schemas import KEYS
from loanline.sources.tables import append, create_if_missing, replace_keys, scan

STREAM, BATCH = "stream_id", "batch_id"


def least_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key, the least by its other columns in order, whatever the order of the input."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    least = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("least"))
    return least.select(*keys, "least.*").select(*rows.columns)


def bind_checkpoint(spark: SparkSession, target: str, stream_id: str, checkpoint: str) -> None:
    """Note the checkpoint of a stream id beside the table, or fail if it has another."""
    bindings = f"{target.rstrip('/')}__streams"
    create_if_missing(spark, bindings, "stream_id string, checkpoint string")
    bound = scan(spark, bindings, "stream_id string, checkpoint string").filter(F.col("stream_id") == stream_id)
    others = [r.checkpoint for r in bound.distinct().limit(2).collect()]
    if others and others != [checkpoint]:
        raise ValueError(f"stream {stream_id!r} already has the checkpoint {others[0]}")
    if not others:
        append(spark.createDataFrame([(stream_id, checkpoint)], "stream_id string, checkpoint string"), bindings)


def ingest_stream(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    target_schema: StructType,
    keys: Sequence[str] = tuple(KEYS),
    *,
    stream_id: str,
) -> StreamingQuery:
    """Append the rows whose key is new, each key once, and stop when the source is drained.

    Every micro-batch is de-duplicated on its keys (the least row of a key stays), anti-joined
    with the table and transformed. It writes its own partition of ``stream_id`` and ``batch_id``,
    so a batch that is run again after a failure replaces its earlier output. Batch numbers start
    anew with each checkpoint, so an id belongs to one checkpoint and is refused with another.
    """
    spark = stream.sparkSession
    schema = StructType([*target_schema.fields, StructField(STREAM, StringType()), StructField(BATCH, LongType())])
    create_if_missing(spark, target, schema, [STREAM, BATCH])
    bind_checkpoint(spark, target, stream_id, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        own = (F.col(STREAM) == stream_id) & (F.col(BATCH) == batch_id)
        fresh = new_records(least_per_key(batch, keys), scan(batch.sparkSession, target, schema).filter(~own), keys)
        named = transform(fresh).withColumns({STREAM: F.lit(stream_id), BATCH: F.lit(batch_id).cast("bigint")})
        replace_keys(named, target, [STREAM, BATCH])

    writer = stream.writeStream.foreachBatch(write).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def new_against_fixed(stream: DataFrame, excluded: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Stream rows whose key is not in a fixed set; later additions to the set are not seen."""
    return new_records(stream, excluded, keys)
