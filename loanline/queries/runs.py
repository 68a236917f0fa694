"""Selecting, ranking and logging training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.functions import canonical_json, metric
from loanline.operators.incremental import not_logged, with_logged_flag
from loanline.operators.runs import best_runs, evaluation_rows, experiment_rows, recent_ranking, top_runs
from loanline.plans.lifecycle import log_evaluations
from loanline.queries.standins import LOGGED_BEFORE, NOW_TEXT, model_of, moment, now, oracle, runs
from loanline.schemas import EVALUATION_LOG, RANKED_METRICS, TRACKED_METRICS
from loanline.sources import scan, work_folder


def earlier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).filter(F.col("start_time") < moment(LOGGED_BEFORE))


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = metric("metrics", "test_recall").alias("test_recall")
    return top_runs(runs(spark, sf_dir)).select("model_type", "run_id", value)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_runs(runs(spark, sf_dir)).select("model_type", "run_name", "run_id")


def best_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_runs(runs(spark, sf_dir), "inference_time", maximize=False)
    return found.select("model_type", "run_name", "run_id")


def evaluation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = earlier_runs(spark, sf_dir).select("run_name")
    return evaluation_rows(runs(spark, sf_dir), log, model_of(), now())


def evaluation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log table created, the earlier runs logged, then all runs, then all runs again."""
    target = work_folder(spark, "evaluations")
    for batch in (earlier_runs(spark, sf_dir), runs(spark, sf_dir), runs(spark, sf_dir)):
        log_evaluations(spark, batch, target, model_of(), moment(NOW_TEXT).cast("timestamp"))
    return scan(spark, target, EVALUATION_LOG).select("run_id", "run_name", "model_type", "primary_metric_value")


def evaluations_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_log(spark, sf_dir).groupBy("model_type").agg(F.count(F.lit(1)).alias("new_evaluations"))


def experiment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per new (type, experiment, hyper-parameters)."""
    logged = earlier_runs(spark, sf_dir).filter(F.col("params")["criterion"] == "gini")
    log = logged.select("model_type", "experiment_name", canonical_json("params").alias("hyperparameters"))
    return experiment_rows(runs(spark, sf_dir), log, now())


def unlogged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_logged(runs(spark, sf_dir), earlier_runs(spark, sf_dir), ["run_name"]).select("run_id", "run_name")


def logged_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = with_logged_flag(runs(spark, sf_dir), earlier_runs(spark, sf_dir), ["run_id"])
    return flagged.select("run_id", "already_logged")


def param_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose type, experiment and parameters were logged by an earlier run."""
    keys = ["model_type", "experiment_name", "params_json"]
    coded = runs(spark, sf_dir).withColumn("params_json", canonical_json("params"))
    logged = coded.filter((F.col("start_time") < moment(LOGGED_BEFORE)) & (F.col("params")["criterion"] == "gini"))
    flagged = with_logged_flag(coded, logged, keys, "duplicate")
    return flagged.select("run_id", "params_json", "duplicate")


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_ranking(runs(spark, sf_dir))


_BEST = "test_recall DESC, start_time, run_id"
_FOUND = f"""SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY {_BEST}) AS place FROM runs"""
_EARLIER = f"start_time < TIMESTAMP '{LOGGED_BEFORE}'"


def json_sql(metrics: list[str], nulls: bool) -> str:
    """JSON text of metric columns in key order; absent ones as null, or left out."""
    shown = "coalesce(CAST({m} AS VARCHAR), 'null')" if nulls else "CAST({m} AS VARCHAR)"
    parts = [f"'\"{m}\":' || " + shown.format(m=m) for m in sorted(metrics)]
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_FRESH = """SELECT *, row_number() OVER (PARTITION BY model_type, run_name ORDER BY test_recall DESC, start_time, run_id)
 AS nth FROM found WHERE run_name NOT IN (SELECT run_name FROM logged)"""
_EVALUATION = dict(found=_FOUND, logged=f"SELECT run_name FROM runs WHERE {_EARLIER}", fresh=_FRESH)


def _ranking_sql() -> str:
    columns = ", ".join(
        f"{m}, rank() OVER (PARTITION BY model_type ORDER BY {m} {'DESC' if larger else 'ASC'} NULLS LAST) AS {m}_rank"
        for m, larger in RANKED_METRICS.items()
    )
    ranked = columns.replace("rank() OVER (", "CAST(rank() OVER (").replace("NULLS LAST)", "NULLS LAST) AS INTEGER)")
    return oracle(
        f"SELECT model_type, run_id, run_name, start_time, {ranked} FROM recent WHERE nth <= 10",
        "runs",
        recent="SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY start_time DESC, run_id) AS nth FROM runs",
    )


def evaluation_log_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three of the unlogged runs of each type, where more are logged than that."""
    found = evaluation_rows(runs(spark, sf_dir), earlier_runs(spark, sf_dir), model_of(), now(), limit=3)
    return found.select("model_type", "run_name", "run_id")


QUERIES = {
    "evaluation_log_limited": (
        evaluation_log_limited,
        oracle(
            f"""SELECT model_type, run_name, run_id FROM (SELECT *, row_number() OVER (PARTITION BY model_type, run_name
 ORDER BY {_BEST}) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY {_BEST}) AS fresh_place FROM runs
 WHERE run_name NOT IN (SELECT run_name FROM runs WHERE {_EARLIER})) WHERE fresh_place <= 3) WHERE nth = 1""",
            "runs",
        ),
    ),
    "top_runs": (
        top,
        oracle("SELECT model_type, run_id, test_recall FROM found WHERE place <= 500", "runs", found=_FOUND),
    ),
    "best_runs": (
        best,
        oracle(
            f"SELECT model_type, run_name, run_id FROM (SELECT *, row_number() OVER (PARTITION BY model_type, run_name "
            f"ORDER BY {_BEST}) AS nth FROM runs) WHERE nth = 1",
            "runs",
        ),
    ),
    "best_runs_minimize": (
        best_lowest,
        oracle(
            "SELECT model_type, run_name, run_id FROM (SELECT *, row_number() OVER (PARTITION BY model_type, run_name "
            "ORDER BY inference_time, start_time, run_id) AS nth FROM runs WHERE inference_time IS NOT NULL) WHERE nth = 1",
            "runs",
        ),
    ),
    "evaluation_log": (
        evaluation_log,
        oracle(
            f"""SELECT TIMESTAMP '{NOW_TEXT}' AS "timestamp", run_id, run_name, model_type, model_name,
 'test_recall' AS primary_metric, test_recall AS primary_metric_value, {json_sql(TRACKED_METRICS, nulls=False)} AS all_metrics_json,
 params_json, model_uri FROM fresh WHERE nth = 1""",
            "runs",
            **_EVALUATION,
        ),
    ),
    "evaluation_job": (
        evaluation_job,
        oracle(
            """SELECT run_id, run_name, model_type, test_recall AS primary_metric_value FROM fresh WHERE nth = 1
UNION ALL SELECT run_id, run_name, model_type, test_recall FROM earlier WHERE nth = 1""",
            "runs",
            first=f"SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY {_BEST}) AS place FROM runs WHERE {_EARLIER}",
            earlier="""SELECT *, row_number() OVER (PARTITION BY model_type, run_name ORDER BY test_recall DESC, start_time,
 run_id) AS nth FROM first""",
            **{**_EVALUATION, "logged": "SELECT run_name FROM earlier"},
        ),
    ),
    "new_evaluations_by_type": (
        evaluations_by_type,
        oracle(
            "SELECT model_type, count(*) AS new_evaluations FROM fresh WHERE nth = 1 GROUP BY model_type",
            "runs",
            **_EVALUATION,
        ),
    ),
    "experiment_log": (
        experiment_log,
        oracle(
            f"""SELECT run_name AS model_name, model_type, run_id, experiment_name, TIMESTAMP '{NOW_TEXT}' AS created_timestamp,
 params_json AS hyperparameters, {json_sql(TRACKED_METRICS, nulls=True)} AS metrics FROM (
  SELECT *, row_number() OVER (PARTITION BY model_type, experiment_name, params_json ORDER BY start_time, run_id) AS nth
  FROM runs) r WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM logged l WHERE l.model_type = r.model_type
  AND l.experiment_name = r.experiment_name AND l.params_json = r.params_json)""",
            "runs",
            logged=f"SELECT * FROM runs WHERE {_EARLIER} AND criterion = 'gini'",
        ),
    ),
    "unlogged_runs": (
        unlogged_runs,
        oracle(
            f"SELECT run_id, run_name FROM runs WHERE run_name NOT IN (SELECT run_name FROM runs WHERE {_EARLIER})",
            "runs",
        ),
    ),
    "already_logged": (
        logged_flag,
        oracle(f"SELECT run_id, {_EARLIER} AS already_logged FROM runs", "runs"),
    ),
    "param_duplicates": (
        param_duplicates,
        oracle(
            """SELECT run_id, params_json, EXISTS (SELECT 1 FROM logged l WHERE l.model_type = r.model_type
 AND l.experiment_name = r.experiment_name AND l.params_json = r.params_json) AS duplicate FROM runs r""",
            "runs",
            logged=f"SELECT * FROM runs WHERE {_EARLIER} AND criterion = 'gini'",
        ),
    ),
    "run_ranking": (ranking, _ranking_sql()),
}
