"""Selecting and recording training runs kept as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanline.functions.maps import canonical_json, metric, pick_all, pick_present, with_default
from loanline.operators.incremental import not_logged
from loanline.schemas import PRIMARY_METRIC, RANKED_METRICS, SEARCH_LIMIT, TRACKED_METRICS


def metric_order(name: str, maximize: bool = True) -> list[Column]:
    """Best metric first, nulls last, then the earlier run."""
    value = metric("metrics", name)
    best = F.desc_nulls_last(value) if maximize else F.asc_nulls_last(value)
    return [best, F.asc("start_time"), F.asc("run_id")]


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int = 1) -> DataFrame:
    """The first rows of each group; Spark cuts every group to that many before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= rows).drop("place")


def of_type(runs: DataFrame, model_type: str) -> DataFrame:
    return runs.filter(F.col("model_type") == model_type)


def name_contains(runs: DataFrame, model_type: Column | str) -> DataFrame:
    """Runs whose name holds the model type; a run without a name holds nothing."""
    return runs.filter(F.coalesce("run_name", F.lit("")).contains(model_type))


def with_metric(runs: DataFrame, name: str = PRIMARY_METRIC) -> DataFrame:
    return runs.filter(metric("metrics", name).isNotNull())


def above_thresholds(runs: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Runs that reach every threshold; an absent metric does not."""
    for name, least in thresholds.items():
        runs = runs.filter(metric("metrics", name) >= least)
    return runs


def top_runs(
    runs: DataFrame, name: str = PRIMARY_METRIC, maximize: bool = True, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """The search result: the best ``limit`` runs of each model type."""
    return first_per(runs, ["model_type"], metric_order(name, maximize), limit)


def best_runs(runs: DataFrame, name: str = PRIMARY_METRIC, maximize: bool = True) -> DataFrame:
    """Best run of each run name."""
    return first_per(with_metric(runs, name), ["model_type", "run_name"], metric_order(name, maximize))


def evaluation_rows(
    runs: DataFrame,
    log: DataFrame,
    model_name: Column,
    when: Column,
    artifact_path: str = "ml_model",
    primary: str = PRIMARY_METRIC,
    maximize: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Log rows of the best run of each name that is not in the log yet.

    ``limit`` takes only so many of the unlogged runs of each model type, the best first.
    """
    fresh = not_logged(runs, log, ["run_name"])
    if limit is not None:
        fresh = top_runs(fresh, primary, maximize, limit)
    return best_runs(fresh, primary, maximize).select(
        when.alias("timestamp"),
        "run_id",
        "run_name",
        "model_type",
        model_name.alias("model_name"),
        F.lit(primary).alias("primary_metric"),
        with_default(metric("metrics", primary)).alias("primary_metric_value"),
        canonical_json(pick_present("metrics", TRACKED_METRICS)).alias("all_metrics_json"),
        canonical_json("params").alias("params_json"),
        F.concat(F.lit("runs:/"), "run_id", F.lit(f"/{artifact_path}")).alias("model_uri"),
    )


def experiment_rows(runs: DataFrame, log: DataFrame, when: Column, check_log: bool = True) -> DataFrame:
    """Log rows of runs whose (type, experiment, hyper-parameters) are new.

    Of several such runs in one batch the earliest is logged, as if they came one by one.
    """
    rows = runs.select(
        F.col("run_name").alias("model_name"),
        "model_type",
        "run_id",
        "experiment_name",
        when.alias("created_timestamp"),
        canonical_json("params").alias("hyperparameters"),
        canonical_json(pick_all("metrics", TRACKED_METRICS)).alias("metrics"),
        "start_time",
    )
    if not check_log:
        return rows.drop("start_time")
    keys = ["model_type", "experiment_name", "hyperparameters"]
    earliest = first_per(rows, keys, [F.asc("start_time"), F.asc("run_id")]).drop("start_time")
    return not_logged(earliest, log, keys).select(rows.drop("start_time").columns)


def recent_ranking(
    runs: DataFrame, metrics: Mapping[str, bool] = RANKED_METRICS, recent: int = 10
) -> DataFrame:
    """Rank on each metric among the latest runs of a model type; absent metrics rank last."""
    latest = first_per(runs, ["model_type"], [F.desc("start_time"), F.asc("run_id")], recent)
    group = Window.partitionBy("model_type")
    ranks = []
    for name, larger in metrics.items():
        value = metric("metrics", name)
        order = F.desc_nulls_last(value) if larger else F.asc_nulls_last(value)
        ranks += [value.alias(name), F.rank().over(group.orderBy(order)).alias(f"{name}_rank")]
    return latest.select("model_type", "run_id", "run_name", "start_time", *ranks)
