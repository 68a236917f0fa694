"""Column lists, record schemas and log-table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: feature list in table order, with their record types ----
LOAN_RECORD = T.StructType(
    [
        T.StructField("checking_balance", T.StringType()),
        T.StructField("months_loan_duration", T.IntegerType()),
        T.StructField("credit_history", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("amount", T.IntegerType()),
        T.StructField("savings_balance", T.StringType()),
        T.StructField("employment_duration", T.StringType()),
        T.StructField("percent_of_income", T.IntegerType()),
        T.StructField("years_at_residence", T.IntegerType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("other_credit", T.StringType()),
        T.StructField("housing", T.StringType()),
        T.StructField("existing_loans_count", T.IntegerType()),
        T.StructField("job", T.StringType()),
        T.StructField("dependents", T.IntegerType()),
        T.StructField("phone", T.StringType()),
    ]
)
FEATURES = LOAN_RECORD.fieldNames()
LABEL = "default"
KEYS = ["id", "start_date", "end_date"]
NOMINAL = ["purpose", "other_credit", "housing", "job", "phone"]

# ---- fixed values: category order of the ordinal columns ----
ORDINAL_CATEGORIES = {
    "checking_balance": ["< 0", "1 - 200", "> 200", "unknown"],
    "savings_balance": ["< 100", "100 - 500", "500 - 1000", "> 1000", "unknown"],
    "employment_duration": ["unemployed", "< 1", "1 - 4", "4 - 7", "> 7", "unknown"],
    "credit_history": ["critical", "poor", "good", "very good", "perfect"],
}

# ---- fixed values: metric lists ----
TRACKED_METRICS = [
    "test_accuracy",
    "test_precision",
    "test_recall",
    "test_f1",
    "test_roc_auc",
    "train_accuracy",
    "train_time",
    "inference_time",
]
COMPARED_METRICS = TRACKED_METRICS[:6]
RANKED_METRICS = {  # metric -> True when larger is better
    "test_f1": True,
    "test_accuracy": True,
    "test_roc_auc": True,
    "test_recall": True,
    "train_time": False,
    "inference_time": False,
}
PRIMARY_METRIC = "test_recall"
TOLERANCE = 0.001
SEARCH_LIMIT = 500

LOAN_TABLE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("start_date", T.TimestampNTZType()),
        T.StructField("end_date", T.TimestampNTZType()),
        *LOAN_RECORD.fields,
        T.StructField(LABEL, T.StringType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("experiment_name", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("model_uri", T.StringType()),
    ]
)


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


EVALUATION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        *_text("run_id", "run_name", "model_type", "model_name", "primary_metric"),
        T.StructField("primary_metric_value", T.DoubleType()),
        *_text("all_metrics_json", "params_json", "model_uri"),
    ]
)
EXPERIMENT_LOG = T.StructType(
    [
        *_text("model_name", "model_type", "run_id", "experiment_name"),
        T.StructField("created_timestamp", T.TimestampType()),
        *_text("hyperparameters", "metrics"),
    ]
)
REGISTRATION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        *_text("run_id", "run_name", "model_type", "model_name", "experiment_name", "primary_metric"),
        T.StructField("primary_metric_value", T.DoubleType()),
        *_text("metrics_json", "params_json"),
        T.StructField("registered", T.BooleanType()),
        *_text("registered_version", "reason"),
    ]
)
UAT_RESULTS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        *_text("model_name", "model_type", "model_version", "run_id", "uat_status"),
        *[T.StructField(n, T.DoubleType()) for n in ("accuracy", "precision", "recall", "f1", "roc_auc")],
        *_text("confusion_matrix_json", "failed_checks_json"),
    ]
)
VERSIONS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("creation_timestamp", T.TimestampType()),
    ]
)
STORED_VERSIONS = T.StructType(
    [
        *VERSIONS.fields,
        T.StructField("params_json", T.StringType()),
        T.StructField("compared", T.ArrayType(T.DoubleType())),
    ]
)
ALIASES = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("version", T.IntegerType()),
    ]
)
