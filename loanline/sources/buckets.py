"""Keyed tables whose rows lie in a fixed number of buckets, replaced by copy.

A replacement writes the buckets that it touches anew, in a folder of its own, and is then committed by one small file
that names the folder each of these buckets is read from. So files grow with the buckets and not with the keys, a reader
sees all of a replacement or nothing, and a job that dies before its commit leaves only files that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loanline.operators.incremental import new_records
from loanline.sources.folders import stored
from loanline.sources.tables import append, exists

#: Enough for some ten million result rows; give a larger table more.
BUCKETS = 16
_BUCKET, _COPY = "key_bucket", "copy"
_COMMITS = "key_bucket int, copy string, turn long, buckets int"


def _live(spark: SparkSession, target: str) -> tuple[dict[int, str], int, int | None]:
    """(folder of each bucket, last turn, number of buckets); as many rows as buckets reach the driver."""
    if not exists(spark, f"{target}/commits"):
        return {}, 0, None
    commits = spark.read.schema(_COMMITS).parquet(f"{target}/commits")
    newest = commits.groupBy(_BUCKET).agg(F.max_by(_COPY, "turn").alias(_COPY), F.max("turn").alias("turn"), F.max("buckets").alias("buckets"))
    rows = newest.collect()
    return {r[_BUCKET]: r[_COPY] for r in rows}, max(r["turn"] for r in rows), rows[0]["buckets"]


def _folders(target: str, live: dict[int, str]) -> list[str]:
    return [f"{target}/rows/{_COPY}={copy}/{_BUCKET}={bucket}" for bucket, copy in sorted(live.items())]


def read_buckets(spark: SparkSession, target: str, schema: StructType | str | None = None) -> DataFrame:
    """The committed rows of the table at the path ``target``; no replaced file is listed or opened.

    A table that is not there yet has no rows, and needs a ``schema``.
    """
    live, _, _ = _live(spark, target)
    if not live:
        if schema is None:
            raise ValueError(f"nothing was stored in {target}")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*_folders(target, live))


def replace_in_buckets(df: DataFrame, target: str, keys: Sequence[str], buckets: int = BUCKETS) -> int:
    """Upsert: rows of ``df`` take the place of stored rows with the same keys; returns how many were given.

    Null equals null in a key. ``buckets`` holds for a new table, a stored one keeps its own number and the types of its
    columns. Without rows nothing changes. A table has one writer at a time, as any that is overwritten.
    """
    spark = df.sparkSession
    live, turn, known = _live(spark, target)
    if live:
        df = df.to(spark.read.parquet(_folders(target, live)[0]).schema)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(known or buckets)).cast("int")
    incoming = stored(df.withColumn(_BUCKET, bucket), "incoming")
    counts = {r[_BUCKET]: r["count"] for r in incoming.groupBy(_BUCKET).count().collect()}
    if not counts:
        return 0
    rows = incoming
    touched = {b: live[b] for b in counts if b in live}
    if touched:
        held = spark.read.schema(df.schema).parquet(*_folders(target, touched))
        rows = new_records(held, incoming, keys).withColumn(_BUCKET, bucket).unionByName(incoming)
    copy = f"c{uuid.uuid4().hex}"
    rows.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{target}/rows/{_COPY}={copy}")
    now = [F.lit(copy).alias(_COPY), F.lit(turn + 1).cast("long").alias("turn"), F.lit(known or buckets).cast("int").alias("buckets")]
    commit = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, counts)).cast("array<int>")).alias(_BUCKET), *now)
    append(commit, f"{target}/commits")
    return sum(counts.values())


def drop_replaced(spark: SparkSession, target: str) -> int:
    """Delete the files that no bucket is read from; returns how many folders went. For when no job reads or writes."""
    live = {f"{_COPY}={copy}/{_BUCKET}={bucket}" for bucket, copy in _live(spark, target)[0].items()}
    if not live:
        return 0
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/rows")
    files, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for copy in files.listStatus(root):
        held = [b for b in files.listStatus(copy.getPath()) if b.isDirectory()]
        dead = [b for b in held if f"{copy.getPath().getName()}/{b.getPath().getName()}" not in live]
        for path in [copy.getPath()] if len(dead) == len(held) else [b.getPath() for b in dead]:
            files.delete(path, True)
        gone += len(dead)
    return gone
