"""Acceptance thresholds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: acceptance thresholds ----
UAT_THRESHOLDS = {
    "min_accuracy": 0.70,
    "min_f1": 0.60,
    "min_roc_auc": 0.75,
    "min_recall": 0.75,
}


def uat_gate(metrics: DataFrame, thresholds: Mapping[str, float] = UAT_THRESHOLDS) -> DataFrame:
    """Add ``failed_checks`` (list of texts) and ``uat_status``.

    ``min_x`` and ``max_x`` bound the column x. A null metric fails its check.
    """
    checks = []
    for name, bound in thresholds.items():
        kind, column = name.split("_", 1)
        value = F.col(column).cast("double")
        sign, failed = ("<", value < bound) if kind == "min" else (">", value > bound)
        shown = F.when(value.isNull(), "null").otherwise(F.format_string("%.4f", value))
        text = F.concat(F.lit(f"{column}: "), shown, F.lit(f" {sign} {bound}"))
        checks.append(F.when(F.coalesce(failed, F.lit(True)), text))
    listed = metrics.withColumn("failed_checks", F.array_compact(F.array(*checks)))
    return listed.withColumn("uat_status", F.when(F.size("failed_checks") == 0, "PASSED").otherwise("FAILED"))
