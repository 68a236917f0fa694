from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: short names of the known model families ----
SHORT_NAMES = {
    "random_forest": "RF",
    "xgboost": "XGB",
    "logistic_regression": "LR",
    "gradient_boosting": "GB",
    "decision_tree": "DT",
    "svm": "SVM",
    "naive_bayes": "NB",
    "knn": "KNN",
}


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def short_name(model_type: Column | str) -> Column:
    """Known short name, else the upper-case initials of the underscore-separated words."""
    col = _col(model_type)
    known = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    words = F.filter(F.split(col, "_"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.coalesce(F.try_element_at(known, col), initials)


def model_name(catalog: str, schema: str, base: str, model_type: Column | str) -> Column:
    return F.concat(F.lit(f"{catalog}.{schema}.{base}_"), _col(model_type))


def experiment_name(base: str, model_type: Column | str) -> Column:
    return F.concat(F.lit(f"{base}_"), short_name(model_type))


def run_name(prefix: str, model_type: Column | str, setting: Column | str) -> Column:
    return F.concat_ws("_", F.lit(prefix), _col(model_type), _col(setting))


def endpoint_name(base: str, model_type: Column | str) -> Column:
    return F.concat(F.lit(base.replace("_", "-") + "-"), _col(model_type), F.lit("-prod"))
