"""Evaluation, registration and promotion jobs over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.operators.gates import uat_gate
from loanline.operators.metrics import binary_metrics, confusion_json, roc_auc
from loanline.operators.registry import (
    production_decisions,
    promoted_aliases,
    register_decisions,
    registration_log_rows,
    staging_decisions,
    version_metrics,
    version_rows,
)
from loanline.operators.runs import evaluation_rows
from loanline.schemas import ALIASES, EVALUATION_LOG, REGISTRATION_LOG, STORED_VERSIONS, UAT_RESULTS
from loanline.sources.buckets import replace_in_buckets
from loanline.sources.folders import cut_lineage
from loanline.sources.tables import append, create_if_missing, replace_keys, scan


def log_evaluations(spark: SparkSession, runs: DataFrame, log: str, model_name: Column, when: Column) -> int:
    """Append the best run of each name that the log lacks."""
    create_if_missing(spark, log, EVALUATION_LOG)
    return append(evaluation_rows(runs, scan(spark, log, EVALUATION_LOG), model_name, when), log)


def register(
    spark: SparkSession, runs: DataFrame, versions: DataFrame, log: str, model_name: Column, when: Column
) -> DataFrame:
    """Decide on all runs, append the decisions to the log and return them."""
    create_if_missing(spark, log, REGISTRATION_LOG)
    stored = scan(spark, log, REGISTRATION_LOG).select("run_id")
    # Written once, so the log grows by exactly the returned rows.
    decided = cut_lineage(register_decisions(runs, stored, versions, model_name, when))
    append(registration_log_rows(decided), log)
    return decided


def register_and_store(
    spark: SparkSession, runs: DataFrame, versions: str, log: str, model_name: Column, when: Column, **options
) -> DataFrame:
    """Decide on all runs against the stored versions, store the new ones, append the log; returns the decisions.

    Numbers go on from the stored versions. These are written first, and a run that has a version counts as logged, so
    a job that broke off between the two tables registers nothing twice. ``options`` go to ``register_decisions``.
    """
    create_if_missing(spark, log, REGISTRATION_LOG)
    create_if_missing(spark, versions, STORED_VERSIONS)
    known = scan(spark, versions, STORED_VERSIONS)
    done = scan(spark, log, REGISTRATION_LOG).select("run_id").union(known.select("run_id"))
    decided = cut_lineage(register_decisions(runs, done, known, model_name, when, **options))
    append(version_rows(decided), versions)
    append(registration_log_rows(decided), log)
    return decided


def uat_rows(scored: DataFrame, model_type: str, when: Column, by: list[str]) -> DataFrame:
    """Acceptance result of each scored model version."""
    metrics = binary_metrics(scored, "label", "prediction", by)
    areas = roc_auc(scored, "label", "probability", by)
    gated = uat_gate(metrics.join(areas, by, "left"))
    failed = F.when(F.size("failed_checks") > 0, F.to_json("failed_checks"))
    return gated.withColumns(
        {
            "timestamp": when,
            "model_type": F.lit(model_type),
            "confusion_matrix_json": confusion_json(),
            "failed_checks_json": failed,
        }
    ).select(*UAT_RESULTS.fieldNames())


def store_uat(rows: DataFrame, target: str) -> int:
    """Replace the stored results of the versions in ``rows``.

    A path is a table in buckets, read by ``read_buckets``; a catalog table has a partition for each version.
    """
    store = replace_in_buckets if "/" in target else replace_keys
    return store(rows, target, ["model_name", "model_version"])


def promote_to_staging(
    spark: SparkSession, versions: DataFrame, runs: DataFrame, aliases: str, maximize: bool = True
) -> DataFrame:
    """Point Staging at the best READY version of each model; returns the decisions."""
    create_if_missing(spark, aliases, ALIASES, ["model_name", "alias"])
    held = scan(spark, aliases, ALIASES)
    decided = cut_lineage(staging_decisions(version_metrics(versions, runs), held, maximize=maximize))
    replace_keys(promoted_aliases(decided, "Staging"), aliases, ["model_name", "alias"])
    return decided


def promote_to_production(spark: SparkSession, versions: DataFrame, aliases: str, results: DataFrame) -> DataFrame:
    """Point Production at staged versions whose newest acceptance result is PASSED."""
    held = scan(spark, aliases, ALIASES)
    decided = cut_lineage(production_decisions(held, versions, results))
    replace_keys(promoted_aliases(decided, "Production"), aliases, ["model_name", "alias"])
    return decided
