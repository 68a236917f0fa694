"""Fitted transforms on shared storage."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from loanline.sources.tables import require_columns


def save_model(model: PipelineModel, path: str, inputs: StructType | None = None) -> None:
    """Save a fitted pipeline, and beside it the schema of the columns it takes."""
    model.write().overwrite().save(f"{path}/model")
    if inputs is not None:
        save_note(SparkSession.active(), inputs.jsonValue(), f"{path}/signature")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def read_signature(spark: SparkSession, path: str) -> StructType:
    return StructType.fromJson(read_note(spark, f"{path}/signature"))


def check_signature(df: DataFrame, signature: StructType) -> DataFrame:
    """Fail before any job runs when a column is absent or has another type than the model was fitted on."""
    require_columns(df, signature.fieldNames())
    found = {f.name: f.dataType for f in df.schema.fields}
    other = [
        f"{f.name} is {found[f.name].simpleString()}, not {f.dataType.simpleString()}"
        for f in signature.fields
        if found[f.name] != f.dataType
    ]
    if other:
        raise ValueError(f"columns the model cannot take: {other}")
    return df


def save_note(spark: SparkSession, note: dict, path: str) -> None:
    """A small JSON object beside stored models."""
    row = [(json.dumps(note, sort_keys=True),)]
    spark.createDataFrame(row, "note string").coalesce(1).write.mode("overwrite").text(path)


def read_note(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
