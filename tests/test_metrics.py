from __future__ import annotations

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from loanline.operators.gates import uat_gate
from loanline.operators.metrics import binary_metrics, class_weights, confusion_json, roc_auc
from loanline.operators.splitting import stratified_split


def _scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p int, s double")


def _brute_auc(rows):
    pos = [s for y, _, s in rows if y == 1]
    neg = [s for y, _, s in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [1, 2, 10, 100000])
def test_auc_equals_all_pairs(spark, levels):
    draw = random.Random(levels)
    rows = [(int(draw.random() < 0.4), 0, draw.randrange(levels) / 7 - 1) for _ in range(300)]
    df = _scored(spark, rows)
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(_brute_auc(rows), abs=1e-12)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(evaluator.evaluate(df), abs=1e-9)
    turned = roc_auc(df.selectExpr("y", "-s AS s"), "y", "s").first()[0]
    assert turned == pytest.approx(1 - _brute_auc(rows), abs=1e-12)


def test_auc_with_many_ranges_and_a_hot_score(spark):
    draw = random.Random(5)
    rows = [(int(draw.random() < 0.3), 0, 0.5 if i % 3 == 0 else draw.random()) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps every range a partition
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert roc_auc(_scored(spark, rows), "y", "s").first()[0] == pytest.approx(_brute_auc(rows), abs=1e-12)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_auc_of_one_class_is_null(spark):
    assert roc_auc(_scored(spark, [(1, 1, 0.2), (1, 0, 0.7)]), "y", "s").first()[0] is None


def test_metrics_without_positive_predictions(spark):
    row = binary_metrics(_scored(spark, [(1, 0, 0.1), (0, 0, 0.2)]), "y", "p").first()
    assert (row["precision"], row.recall, row.f1, row.accuracy, row.hard_auc) == (0.0, 0.0, 0.0, 0.5, 0.5)


def test_confusion_adds_up(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(2), draw.randrange(2), 0.0) for _ in range(500)]
    row = binary_metrics(_scored(spark, rows), "y", "p").withColumn("j", confusion_json()).first()
    assert row.tn + row.fp + row.fn + row.tp == 500
    assert row.j == f"[[{row.tn},{row.fp}],[{row.fn},{row.tp}]]"


def test_hard_auc_equals_auc_of_predictions(spark):
    draw = random.Random(2)
    rows = [(y, p, float(p)) for y, p in ((draw.randrange(2), draw.randrange(2)) for _ in range(200))]
    df = _scored(spark, rows)
    assert binary_metrics(df, "y", "p").first().hard_auc == pytest.approx(roc_auc(df, "y", "s").first()[0], abs=1e-12)


def test_balanced_weights(spark):
    weights = {r.y: r.weight for r in class_weights(_scored(spark, [(1, 0, 0.0)] * 1 + [(0, 0, 0.0)] * 3), "y").collect()}
    assert weights == {1: 2.0, 0: 4 / 6}


def test_gate(spark):
    rows = [(0.9, 0.9, 0.9, 5), (0.9, None, 0.1, 50)]
    df = spark.createDataFrame(rows, "accuracy double, roc_auc double, recall double, latency int")
    bounds = {"min_accuracy": 0.7, "min_roc_auc": 0.75, "min_recall": 0.75, "max_latency": 10}
    passed, failed = uat_gate(df, bounds).orderBy("latency").collect()
    assert (passed.uat_status, passed.failed_checks) == ("PASSED", [])
    assert failed.uat_status == "FAILED"
    assert failed.failed_checks == ["roc_auc: null < 0.75", "recall: 0.1000 < 0.75", "latency: 50.0000 > 10"]


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_split_is_exact_and_stable(spark, digits):
    df = spark.range(1003).selectExpr("id", "CAST(id % 3 = 0 AS int) AS y")
    split = stratified_split(df, "y", "id", {"test": 0.2, "validation": 0.1}, digits=digits)
    sizes = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert sizes == {
        (1, "test"): 67, (1, "validation"): 34, (1, "train"): 234,
        (0, "test"): 134, (0, "validation"): 66, (0, "train"): 468,
    }
    again = stratified_split(df.repartition(7), "y", "id", {"test": 0.2, "validation": 0.1})
    assert split.exceptAll(again).count() == 0
    other = stratified_split(df, "y", "id", {"test": 0.2, "validation": 0.1}, seed=7)
    assert split.exceptAll(other).count() > 0


def test_rows_of_a_hot_key_stay_together(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, id) AS id", "1 AS y")
    found = stratified_split(df, "y", "id")
    assert found.count() == 3000
    assert found.filter("id = -1").select("split").distinct().count() == 1
    assert found.select("split").distinct().count() == 2


def test_rows_without_a_label_or_prediction_are_counted(spark):
    rows = [(1, 1), (0, 1), (None, 1), (1, None), (2, 0), (0, 0)]
    df = spark.createDataFrame(rows, "y int, p int")
    found = binary_metrics(df, "y", "p", unscored=True).first()
    assert (found.tn, found.fp, found.fn, found.tp, found.unscored) == (1, 1, 0, 1, 3)
    assert "unscored" not in binary_metrics(df, "y", "p").columns
