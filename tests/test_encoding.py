from __future__ import annotations

import math
import statistics

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanline.operators.splitting import stratified_split
from loanline.operators.encoding import (
    Summary,
    category_index,
    fit_one_hot,
    fit_scaler,
    fit_training_features,
    one_hot,
    scale,
    slot_names,
    summarise,
)
from loanline.operators.hyperparams import zip_params


def test_index_order_breaks_ties_by_text(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert {r.value: r["index"] for r in category_index(df, ["v"]).collect()} == {"c": 0, "a": 1, "b": 2}


def test_unseen_and_null_become_zero_vectors(spark):
    seen = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    rows = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "v string")
    found = one_hot(rows, fit_one_hot(seen, ["v"]), ["v"]).select(vector_to_array("v_vec")).collect()
    assert [r[0] for r in found] == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_too_many_categories(spark):
    df = spark.range(2000).selectExpr("CAST(id AS string) AS v")
    with pytest.raises(ValueError, match="too many distinct values"):
        fit_one_hot(df, ["v"], max_categories=100)


def _numbers(spark):
    return spark.createDataFrame([(1, 1.0, 5.0), (2, None, 5.0), (3, 3.0, 5.0), (4, 8.0, 5.0)], "id bigint, x double, c double")


def test_null_fails_the_default_scaler(spark):
    with pytest.raises(Exception, match="null"):
        fit_scaler(_numbers(spark))


def test_skip_and_impute(spark):
    df = _numbers(spark)
    skipped = scale(df, fit_scaler(df, invalid="skip"), ["id"])
    assert skipped.count() == 3
    filled = scale(df, fit_scaler(df, impute="mean"), ["id"]).orderBy("id").select(vector_to_array("features")).collect()
    assert filled[1][0] == [0.0, 0.0]  # the mean, and the constant column


def test_scaled_values_and_names(spark):
    df = _numbers(spark).dropna()
    scaled = scale(df, fit_scaler(df), ["id"])
    assert slot_names(scaled) == ["x", "c"]
    spread = statistics.stdev([1.0, 3.0, 8.0])
    first = scaled.orderBy("id").select(vector_to_array("features")).first()[0]
    assert first == pytest.approx([(1 - 4) / spread, 0.0])


def test_training_features_use_the_population_deviation(spark):
    df = spark.createDataFrame([("a", 1), ("", 2), (None, 6)], "t string, n int")
    model = fit_training_features(df, ["t", "n"])
    rows = model.transform(df).select("t", vector_to_array("features").alias("f")).collect()
    spread = statistics.pstdev([1, 2, 6])
    assert [r.f[-1] for r in rows] == pytest.approx([(n - 3) / spread for n in (1, 2, 6)])
    assert sorted(tuple(r.f[:3]) for r in rows) == [(0, 0, 1), (0, 1, 0), (1, 0, 0)]  # null and blank are categories
    unseen = spark.createDataFrame([("z", 3)], "t string, n int")
    assert model.transform(unseen).select(vector_to_array("features")).first()[0] == [0.0, 0.0, 0.0, 0.0]


def test_zip(spark):
    lists = {"a": ["1", "2", "3"], "b": ["x"], "c": ["p", None]}
    df = spark.createDataFrame([("g", lists), ("none", {})], "grid string, lists map<string,array<string>>")
    rows = zip_params(df).orderBy("run").collect()
    assert [(r.grid, r.run, r.params["a"], r.params["b"], r.params["c"]) for r in rows] == [
        ("g", 1, "1", "x", "p"), ("g", 2, "2", "x", None), ("g", 3, "3", "x", None),
    ]


def test_zip_refuses_an_empty_list(spark):
    df = spark.createDataFrame([({"a": ["1"], "b": []},)], "lists map<string,array<string>>")
    with pytest.raises(Exception, match="hyper-parameter list is empty"):
        zip_params(df).collect()


def test_zip_long_lists(spark):
    df = spark.range(1).select(
        F.create_map(F.lit("a"), F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda x: x.cast("string"))).alias("lists")
    )
    assert zip_params(df).agg(F.sum(F.col("params")["a"].cast("int"))).first()[0] == math.comb(5001, 2)


def test_rows_without_a_label_are_split_like_others(spark):
    df = spark.range(500).selectExpr("id", "if(id < 250, NULL, 1) AS label")
    sizes = stratified_split(df, "label", "id").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in sizes} == {(None, "test"): 50, (None, "train"): 200, (1, "test"): 50, (1, "train"): 200}


def test_columns_with_different_numbers_of_categories(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", None), (None, "x")], "v string, w string")
    found = one_hot(df, fit_one_hot(df, ["v", "w"]), ["v", "w"])
    slots = [(list(r[0]), list(r[1])) for r in found.select(vector_to_array("v_vec"), vector_to_array("w_vec")).collect()]
    assert slots == [([0.0, 1.0], [1.0]), ([1.0, 0.0], [1.0]), ([1.0, 0.0], [0.0]), ([0.0, 0.0], [1.0])]


def test_summary_in_one_scan(spark):
    rows = [("a", 1, 1.0), ("b", 2, None), ("b", None, float("nan")), (None, 6, 4.0)]
    df = spark.createDataFrame(rows, "v string, n int, x double")
    found = summarise(df, ["v"], ["n", "x"], "mean")
    assert found == Summary(4, {"v": ["b", "a"]}, {"n": 3.0, "x": 2.5})
    assert summarise(df, ["v"], max_categories=2).values == {"v": ["b", "a"]}
    with pytest.raises(ValueError, match="too many distinct values"):
        summarise(df, ["v"], max_categories=1)
    assert summarise(df.limit(0), ["v"], ["n"], "mean") == Summary(0, {"v": []}, {"n": None})
    with pytest.raises(ValueError, match="no value to fill"):
        fit_scaler(df.select(F.lit(None).cast("double").alias("x"), "n"), impute="median")
