"""A history of keyed rows that increments can be appended to without reading all of it.

Rows lie in partitions (by date, say). Beside them is an index: of each partition, bitmaps of its hashed keys. An
increment compares its own bitmaps with these first, and joins only with the partitions that may hold one of its keys.
A bitmap misses no key that is there, so the result is that of a join with the whole history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.operators.incremental import new_records
from loanline.sources.folders import stored
from loanline.sources.tables import append, exists

#: Places that keys are hashed to; 32,768 of them are one bitmap of 4 kB. A key is looked for in a partition without it
#: with a chance of the partition's keys by places.
PLACES = 1 << 24


def key_bitmaps(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(partition columns, bucket, bits): bitmaps of the hashed keys, reduced in each task before the shuffle."""
    place = F.pmod(F.xxhash64(*keys), F.lit(PLACES))
    placed = df.select(*by, place.alias("place"))
    return placed.groupBy(*by, F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )


def partitions_to_read(index: DataFrame, incoming: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The partitions of which a bitmap shares a place with the keys of ``incoming``; few columns, a row a partition."""
    held = index.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    wanted = key_bitmaps(incoming, keys).withColumnRenamed("bits", "wanted")
    both = held.join(wanted, "bucket").select(*by, "bucket", F.explode(F.array("bits", "wanted")).alias("bits"))
    shared = both.groupBy(*by, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return shared.filter(F.bitmap_count("bits") > 0).select(*by).distinct()


def _as_stored(df: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in the types of the table: hashes of equal values differ by type."""
    kinds = {f.name: f.dataType for f in history.schema.fields}
    return df.withColumns({k: F.col(k).cast(kinds[k]) for k in keys if df.schema[k].dataType != kinds[k]})


def read_partitions(history: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of the listed partitions; no other folder is opened. A partition is a row on the driver, as in any listing."""
    chosen = parts.collect()
    whole = [reduce(and_, [F.col(c).isNull() if row[c] is None else F.col(c) == F.lit(row[c]) for c in by]) for row in chosen]
    return history.filter(reduce(or_, whole)) if whole else history.filter(F.lit(False))


def new_to_history(spark: SparkSession, raw: DataFrame, folder: str, keys: Sequence[str], by: Mapping[str, str], null_safe: bool = True) -> DataFrame:
    """Rows of ``raw`` whose key the history in ``folder`` does not have."""
    history, index = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/keys")
    incoming = _as_stored(raw, history, keys)
    parts = partitions_to_read(index, incoming, keys, list(by))
    return new_records(incoming, read_partitions(history, parts, list(by)), keys, null_safe)


def append_new(
    spark: SparkSession, raw: DataFrame, folder: str, keys: Sequence[str], by: Mapping[str, str], null_safe: bool = True
) -> int:
    """Append the rows whose key is new to the history in ``folder``, partitioned by ``by``; returns how many.

    ``by`` gives each partition column as a SQL expression over the row. The index is written before the rows: a job that
    dies between the two leaves places without keys, which cost a read and lose nothing.
    """
    known = exists(spark, f"{folder}/rows")
    fresh = new_to_history(spark, raw, folder, keys, by, null_safe) if known else raw
    fresh = stored(fresh.withColumns({name: F.expr(text) for name, text in by.items()}), "fresh")
    append(key_bitmaps(fresh, keys, list(by)), f"{folder}/keys")
    return append(fresh, f"{folder}/rows", partition_by=list(by))
