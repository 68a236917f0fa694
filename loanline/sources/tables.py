"""Reading and writing tables. A target with a slash is a path, any other a catalog table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loanline.schemas import FEATURES, LABEL


def _save(writer: DataFrameWriter, target: str) -> None:
    writer.save(target) if "/" in target else writer.saveAsTable(target)


def scan(spark: SparkSession, target: str, schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """All rows; ``schema`` names the columns wanted, in order, and their types. Absent ones are null."""
    if "/" not in target:
        whole = spark.read.table(target)
        if schema is None:
            return whole
        return whole.to(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(target)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail before any job runs when a column is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the input lacks {missing}")
    return df


def project_features(
    df: DataFrame, features: Sequence[str] = tuple(FEATURES), label: str | None = LABEL, keys: Sequence[str] = ()
) -> DataFrame:
    """Keys, features in list order, and the label (where there is one) renamed to ``label``."""
    require_columns(df, [*keys, *features])
    target = [F.col(label).alias("label")] if label in df.columns else []
    return df.select(*keys, *features, *target)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Count rows while they are written; ``observation.get["rows"]`` after the action."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _write(df: DataFrame, target: str, mode: str, partition_by: Sequence[str], fmt: str) -> int:
    watched, seen = counted(df)
    writer = watched.write.format(fmt).mode(mode)
    _save(writer.partitionBy(*partition_by) if partition_by else writer, target)
    return seen.get["rows"]


def overwrite(df: DataFrame, target: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> int:
    """Replace the table; returns the rows written."""
    return _write(df, target, "overwrite", partition_by, fmt)


def append(df: DataFrame, target: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> int:
    """Add rows, and new columns where the rows bring some.

    A failed append raises and never replaces the table.
    """
    spark = df.sparkSession
    if "/" not in target and spark.catalog.tableExists(target):
        stored = spark.table(target).columns
        added = [f for f in df.schema.fields if f.name not in stored]
        if added:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            spark.sql(f"ALTER TABLE {target} ADD COLUMNS ({columns})")
        absent = {c: F.lit(None) for c in stored if c not in df.columns}
        df = df.withColumns(absent) if absent else df
    return _write(df, target, "append", partition_by, fmt)


def replace_keys(df: DataFrame, target: str, keys: Sequence[str], fmt: str = "parquet") -> int:
    """Upsert: rows of ``df`` take the place of stored rows with the same keys.

    The table is partitioned by the keys and only the partitions that occur in ``df``
    are rewritten, so a rerun gives the same table. Rows of a key are brought together before the write, those of a
    large key in several tasks.
    """
    spark = df.sparkSession
    watched, seen = counted(df.hint("rebalance", *keys))
    writer = watched.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if "/" in target:
        writer.partitionBy(*keys).save(target)
    elif spark.catalog.tableExists(target):
        ordered = watched.select(*spark.table(target).columns).write
        ordered.option("partitionOverwriteMode", "dynamic").insertInto(target, overwrite=True)
    else:
        writer.partitionBy(*keys).saveAsTable(target)
    return seen.get["rows"]


def read_evolved(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """Read a table whose later files have more columns than its first ones."""
    return spark.read.format(fmt).option("mergeSchema", "true").load(target) if "/" in target else spark.table(target)


def exists(spark: SparkSession, target: str) -> bool:
    """Whether a path or catalog table is there."""
    if "/" not in target:
        return spark.catalog.tableExists(target)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def create_if_missing(
    spark: SparkSession, target: str, schema: StructType, partition_by: Sequence[str] = (), fmt: str = "parquet"
) -> None:
    """Create an empty table with the given schema; an existing one is left alone."""
    writer = spark.createDataFrame([], schema).write.format(fmt).mode("ignore")
    _save(writer.partitionBy(*partition_by) if partition_by else writer, target)
