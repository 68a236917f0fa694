from __future__ import annotations

import pytest

from loanline.schemas import ALIASES, UAT_RESULTS
from loanline.sources import (
    append,
    create_if_missing,
    overwrite,
    read_evolved,
    read_signature,
    replace_keys,
    save_model,
    scan,
    work_folder,
)


@pytest.fixture(params=["path", "catalog"])
def target(request, spark, folder):
    if request.param == "path":
        yield f"{folder}/t"
    else:
        name = "loan_test_table"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        yield name
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_overwrite_reports_rows(spark, target):
    assert overwrite(spark.range(5), target) == 5
    assert overwrite(spark.range(3), target) == 3
    assert scan(spark, target).count() == 3


def test_append_and_new_columns(spark, target):
    append(spark.createDataFrame([(1, "a")], "id bigint, x string"), target)
    append(spark.createDataFrame([(2, "b", 0.5)], "id bigint, x string, y double"), target)
    append(spark.createDataFrame([(3, "c")], "id bigint, x string"), target)
    df = read_evolved(spark, target)
    assert _rows(df.select("id", "x", "y")) == [(1, "a", None), (2, "b", 0.5), (3, "c", None)]


def test_create_if_missing_keeps_rows(spark, target):
    create_if_missing(spark, target, ALIASES)
    assert scan(spark, target, ALIASES).count() == 0
    append(spark.createDataFrame([("m", "Staging", 1)], ALIASES), target)
    create_if_missing(spark, target, ALIASES)
    assert scan(spark, target, ALIASES).count() == 1


def test_scan_of_a_catalog_table_takes_the_schema(spark):
    spark.sql("DROP TABLE IF EXISTS scanned_by_schema")
    append(spark.createDataFrame([(1, "a")], "id int, x string"), "scanned_by_schema")
    found = scan(spark, "scanned_by_schema", "x string, id long, y double")
    assert found.schema.simpleString() == "struct<x:string,id:bigint,y:double>"
    assert _rows(found) == [("a", 1, None)]
    spark.sql("DROP TABLE scanned_by_schema")


def test_replace_keys(spark, target):
    schema = "version int, model_name string, alias string"
    keys = ["model_name", "alias"]
    replace_keys(spark.createDataFrame([(1, "a.b", "S"), (2, "c", "S")], schema), target, keys)
    for _ in range(2):
        replace_keys(spark.createDataFrame([(9, "a.b", "S"), (4, "c", "P")], schema), target, keys)
    found = scan(spark, target, "version int, model_name string, alias string")
    assert _rows(found.select("model_name", "alias", "version")) == [("a.b", "S", 9), ("c", "P", 4), ("c", "S", 2)]


def test_replace_with_nothing_keeps_the_table(spark, target):
    schema = "version int, model_name string"
    replace_keys(spark.createDataFrame([(1, "a")], schema), target, ["model_name"])
    assert replace_keys(spark.createDataFrame([], schema), target, ["model_name"]) == 0
    assert scan(spark, target, schema).count() == 1


def test_version_keys_keep_their_type(spark, folder):
    target = f"{folder}/uat"
    fields = UAT_RESULTS.fieldNames()
    row = {f: None for f in fields} | {"model_name": "m", "model_version": "007", "uat_status": "PASSED"}
    replace_keys(spark.createDataFrame([tuple(row[f] for f in fields)], UAT_RESULTS), target, ["model_name", "model_version"])
    assert scan(spark, target, UAT_RESULTS).first().model_version == "007"


def test_work_folder_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = work_folder(spark, "x"), work_folder(spark, "x")
    assert first.startswith(shared) and first != second


def test_model_signature(spark, folder):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(1.0, 2)], "a double, b int")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f")]).fit(df)
    save_model(model, folder, df.schema)
    save_model(model, folder, df.schema)
    assert read_signature(spark, folder) == df.schema
