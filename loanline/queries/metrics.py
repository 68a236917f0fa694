"""Classification metrics, class weights and acceptance gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.operators import metrics
from loanline.operators.gates import UAT_THRESHOLDS, uat_gate
from loanline.operators.scoring import inference_rows, risk_rows
from loanline.plans.lifecycle import store_uat, uat_rows
from loanline.queries.standins import NOW_TEXT, now, oracle, scores, table
from loanline.schemas import FEATURES, UAT_RESULTS
from loanline.sources import read_buckets, require_columns, work_folder


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_counts(table(spark, sf_dir, "labels"), "quality")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(table(spark, sf_dir, "labels"), "quality")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.binary_metrics(scores(spark, sf_dir), "y_true", "y_pred")
    return rows.withColumn("confusion_json", metrics.confusion_json())


def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_metrics(scores(spark, sf_dir), "y_true", "y_pred", ["lang", "source"])


def confusion_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has no prediction: it is in no cell and counted."""
    rows = scores(spark, sf_dir).withColumn("y_pred", F.when(F.col("id") % 7 > 0, F.col("y_pred")))
    return metrics.binary_metrics(rows, "y_true", "y_pred", ["lang"], unscored=True)


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(scores(spark, sf_dir), "y_true", "score")


def roc_auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some groups have one class only."""
    return metrics.roc_auc(scores(spark, sf_dir), "y_true", "score", ["lang", "source"])


def roc_auc_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many ties: the score of an order line is its quantity."""
    lines = table(spark, sf_dir, "lineitem")
    truth = (F.col("l_returnflag") == "R").cast("int")
    return metrics.roc_auc(lines.select("l_linestatus", truth.alias("y"), "l_quantity"), "y", "l_quantity", ["l_linestatus"])


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric record of each scored run (language)."""
    rows = scores(spark, sf_dir)
    joined = metrics.binary_metrics(rows, "y_true", "y_pred", ["lang"]).join(
        metrics.roc_auc(rows, "y_true", "score", ["lang"]), "lang", "left"
    )
    names = {"accuracy": "test_accuracy", "precision": "test_precision", "recall": "test_recall", "f1": "test_f1"}
    listed = joined.withColumnsRenamed({**names, "roc_auc": "test_roc_auc"})
    return listed.unpivot(["lang"], [*names.values(), "test_roc_auc"], "metric", "value")


def _scored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select(
        F.concat(F.lit("scorer_"), "lang").alias("model_name"),
        F.col("source").alias("model_version"),
        F.concat_ws("/", "lang", "source").alias("run_id"),
        F.col("y_true").alias("label"),
        F.col("y_pred").alias("prediction"),
        F.col("score").alias("probability"),
    )


_UAT_KEYS = ["model_name", "model_version", "run_id"]


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_versions(spark, sf_dir)
    joined = metrics.binary_metrics(rows, "label", "prediction", _UAT_KEYS).join(
        metrics.roc_auc(rows, "label", "probability", _UAT_KEYS), _UAT_KEYS, "left"
    )
    gated = uat_gate(joined, {**UAT_THRESHOLDS, "max_fp": 3})
    return gated.select(*_UAT_KEYS, "uat_status", F.concat_ws("; ", "failed_checks").alias("failed_checks"))


def uat_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance results of every version, stored twice: the second replaces the first."""
    target = work_folder(spark, "uat")
    rows = uat_rows(_scored_versions(spark, sf_dir), "random_forest", now(), _UAT_KEYS)
    store_uat(rows, target)
    store_uat(rows, target)
    fields = {f.name: f for f in UAT_RESULTS.fields}
    types = ", ".join(f"`{n}` {'timestamp_ntz' if n == 'timestamp' else f.dataType.simpleString()}" for n, f in fields.items())
    return read_buckets(spark, target, types)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("id", F.col("y_pred").alias("prediction"), F.col("score").alias("probability"))


def batch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rows(_scored(spark, sf_dir), now(), ["id"])


def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that come back as text; the words among them are no numbers."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    answer = F.when(F.col("lang") == "fr", "unavailable").otherwise(F.col("quality").cast("string"))
    rows = require_columns(labels.join(documents, "doc_id"), ["quality", "lang"])
    rows = rows.select("doc_id", answer.alias("prediction"))
    return inference_rows(rows, F.lit("random_forest"), F.lit("loan-scorer-random_forest-prod"), now())


def scoring_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns checked before any job; the label is optional."""
    from loanline.queries.standins import loans
    from loanline.sources import project_features

    return project_features(loans(spark, sf_dir).drop("default"), FEATURES, "default", ["id"])


def _confusion_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {keys}
 count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
 count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp
FROM scores{group}"""


def _div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


_RATIOS = f"""coalesce({_div("tp + tn", "tp + tn + fp + fn")}, 0) AS accuracy,
 coalesce({_div("tp", "tp + fp")}, 0) AS "precision", coalesce({_div("tp", "tp + fn")}, 0) AS recall,
 coalesce({_div("2 * tp", "2 * tp + fp + fn")}, 0) AS f1"""
_HARD = f"""({_div("tp", "tp + fn")} + {_div("tn", "tn + fp")}) / 2 AS hard_auc"""


def _auc_parts(by: str, source: str, truth: str, score: str) -> dict[str, str]:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return {
        "ties": f"""SELECT {keys}{score} AS s, count(*) FILTER (WHERE {truth} = 1) AS p,
 count(*) FILTER (WHERE {truth} = 0) AS q FROM {source} GROUP BY {keys}{score}""",
        "below": f"""SELECT *, coalesce(sum(q) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
 AS b FROM ties""",
        "areas": f"""SELECT {keys}CAST(sum(p * (2 * b + q)) AS DOUBLE) / 2
 / nullif(CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE), 0) AS roc_auc FROM below{group}""",
    }


def _uat_sql(select: str) -> str:
    return oracle(
        select,
        "scores",
        **_auc_parts("lang, source", "scores", "y_true", "score"),
        cells=_confusion_sql("lang, source"),
        ratios=f"SELECT c.*, {_RATIOS}, roc_auc FROM cells c JOIN areas a ON a.lang = c.lang AND a.source = c.source",
        checked="SELECT *, "
        + ", ".join(
            f"CASE WHEN coalesce({m} {sign} CAST({bound} AS DOUBLE), TRUE) THEN '{m}: ' || coalesce(printf('%.4f', "
            f"CAST({m} AS DOUBLE)), 'null') || ' {sign} {bound}' END AS c{i}"
            for i, (m, sign, bound) in enumerate(
                [("accuracy", "<", 0.7), ("f1", "<", 0.6), ("roc_auc", "<", 0.75), ("recall", "<", 0.75), ("fp", ">", 3)]
            )
        )
        + " FROM ratios",
    )


QUERIES = {
    "label_distribution": (label_distribution, "SELECT quality, count(*) AS n FROM labels GROUP BY quality"),
    "class_weights": (
        class_weights,
        """SELECT quality, count(*) AS n, CAST((SELECT count(*) FROM labels) AS DOUBLE)
 / CAST((SELECT count(DISTINCT quality) FROM labels) * count(*) AS DOUBLE) AS weight FROM labels GROUP BY quality""",
    ),
    "confusion_metrics": (
        confusion_metrics,
        oracle(
            f"SELECT *, {_RATIOS}, {_HARD}, '[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]' "
            "AS confusion_json FROM cells",
            "scores",
            cells=_confusion_sql(""),
        ),
    ),
    "confusion_unscored": (
        confusion_unscored,
        oracle(
            f"SELECT c.*, {_RATIOS}, {_HARD} FROM cells c",
            "scores",
            missing="SELECT * REPLACE (CASE WHEN id % 7 > 0 THEN y_pred END AS y_pred) FROM scores",
            cells=_confusion_sql("lang").replace(
                "FROM scores", ", count(*) FILTER (WHERE y_pred IS NULL) AS unscored FROM missing"
            ),
        ),
    ),
    "confusion_by_group": (
        confusion_by_group,
        oracle(f"SELECT *, {_RATIOS}, {_HARD} FROM cells", "scores", cells=_confusion_sql("lang, source")),
    ),
    "roc_auc": (roc_auc, oracle("SELECT roc_auc FROM areas", "scores", **_auc_parts("", "scores", "y_true", "score"))),
    "roc_auc_by_group": (
        roc_auc_by_group,
        oracle("SELECT * FROM areas", "scores", **_auc_parts("lang, source", "scores", "y_true", "score")),
    ),
    "roc_auc_with_ties": (
        roc_auc_of_events,
        oracle(
            "SELECT * FROM areas",
            lines="SELECT l_linestatus, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity FROM lineitem",
            **_auc_parts("l_linestatus", "lines", "y", "l_quantity"),
        ),
    ),
    "run_metrics": (
        run_metrics,
        oracle(
            """SELECT r.lang, metric, value FROM (
 SELECT lang, 'test_accuracy' AS metric, accuracy AS value FROM ratios UNION ALL
 SELECT lang, 'test_precision', "precision" FROM ratios UNION ALL SELECT lang, 'test_recall', recall FROM ratios UNION ALL
 SELECT lang, 'test_f1', f1 FROM ratios UNION ALL SELECT lang, 'test_roc_auc', roc_auc FROM areas) r""",
            "scores",
            **_auc_parts("lang", "scores", "y_true", "score"),
            cells=_confusion_sql("lang"),
            ratios=f"SELECT lang, {_RATIOS} FROM cells",
        ),
    ),
    "uat_gate": (
        gate,
        _uat_sql(
            """SELECT 'scorer_' || lang AS model_name, source AS model_version, lang || '/' || source AS run_id,
 CASE WHEN concat_ws('; ', c0, c1, c2, c3, c4) = '' THEN 'PASSED' ELSE 'FAILED' END AS uat_status,
 concat_ws('; ', c0, c1, c2, c3, c4) AS failed_checks FROM checked"""
        ),
    ),
    "uat_upsert": (
        uat_upsert,
        _uat_sql(
            f"""SELECT TIMESTAMP '{NOW_TEXT}' AS "timestamp", 'scorer_' || lang AS model_name,
 'random_forest' AS model_type, source AS model_version, lang || '/' || source AS run_id,
 CASE WHEN concat_ws('; ', c0, c1, c2, c3) = '' THEN 'PASSED' ELSE 'FAILED' END AS uat_status,
 accuracy, "precision", recall, f1, roc_auc,
 '[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]' AS confusion_matrix_json,
 CASE WHEN concat_ws('; ', c0, c1, c2, c3) <> '' THEN '["' || concat_ws('","', c0, c1, c2, c3) || '"]' END
 AS failed_checks_json FROM checked"""
        ),
    ),
    "batch_score_labels": (
        batch_labels,
        oracle(
            f"""SELECT id, y_pred AS prediction, CASE WHEN y_pred = 1 THEN 'High Risk' ELSE 'Low Risk' END AS prediction_label,
 score AS probability_of_default, round(1 - score, 6) + CAST(0 AS DOUBLE) AS probability_of_not_default,
 TIMESTAMP '{NOW_TEXT}' AS "timestamp" FROM scores""",
            "scores",
        ),
    ),
    "inference_rows": (
        inference,
        f"""SELECT l.doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE quality END AS prediction,
 CASE WHEN lang = 'fr' THEN NULL WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS prediction_label,
 TIMESTAMP '{NOW_TEXT}' AS prediction_timestamp, 'RANDOM_FOREST' AS model_type,
 'loan-scorer-random_forest-prod' AS endpoint
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    ),
    "scoring_input": (scoring_input, oracle(f"SELECT id, {', '.join(FEATURES)} FROM loans", "loans")),
}
