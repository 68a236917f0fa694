"""Shapes of the physical plans that matter at scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanline.operators.incremental import new_records
from loanline.operators.runs import best_runs
from loanline.operators.splitting import stratified_split
from loanline.plans.preprocessing import run_steps
from loanline.queries.standins import runs, table
from loanline.schemas import LOAN_TABLE
from loanline.sources import overwrite, project_features, scan

SF_DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_steps_do_not_shuffle(spark, folder):
    from loanline.queries.standins import loans

    overwrite(loans(spark, SF_DIR), f"{folder}/loans")
    steps = _plan(run_steps(project_features(scan(spark, f"{folder}/loans", LOAN_TABLE))))
    assert "Exchange" not in steps and "PythonUDF" not in steps


def test_only_needed_columns_are_read(spark, folder):
    from loanline.queries.standins import loans

    overwrite(loans(spark, SF_DIR), f"{folder}/loans")
    steps = run_steps(project_features(scan(spark, f"{folder}/loans", LOAN_TABLE))).select("monthly_income")
    read = _plan(steps).split("ReadSchema: ")[1]
    assert read.startswith("struct<months_loan_duration:int,amount:int,percent_of_income:int>")


def test_split_does_not_shuffle_the_rows(spark):
    orders = table(spark, SF_DIR, "orders")
    plan = _plan(stratified_split(orders, "o_orderstatus", "o_orderkey")).split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_best_runs_cut_groups_before_the_shuffle(spark):
    plan = _plan(best_runs(runs(spark, SF_DIR)))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_anti_join_has_equality_keys(spark):
    df = spark.range(10).selectExpr("id", "id AS start_date", "id AS end_date")
    for null_safe in (True, False):
        plan = _plan(new_records(df, df, null_safe=null_safe))
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "LeftAnti" in plan


def test_hot_key_of_the_anti_join_is_split(spark):
    """A third of the rows share one key: its partition is read by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(60000).selectExpr(
            "IF(id % 3 = 0, 0, id) AS id", "id AS start", "CAST(NULL AS bigint) AS end", "uuid() AS payload"
        )
        raw = rows.withColumn("start", F.when(F.col("id") > 0, F.col("start")).otherwise(0)).repartition(12)
        known = raw.filter("id > 30000").select("id", "start", "end")
        for null_safe, expected in ((True, 40000), (False, 60000)):
            found = new_records(raw, known, ["id", "start", "end"], null_safe)
            assert len(found.collect()) == expected
            if null_safe:
                assert "skew=true" in _plan(found)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
