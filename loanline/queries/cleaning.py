"""Projection, filters, labels and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.functions import endpoint_name, experiment_name, metric, model_name, run_name, short_name, with_default
from loanline.operators import cleaning
from loanline.operators.encoding import ordinal_encode
from loanline.operators.incremental import distinct_keys, new_records
from loanline.operators.runs import above_thresholds, name_contains, of_type, with_metric
from loanline.plans.history import append_new
from loanline.plans.preprocessing import run_steps
from loanline.queries.standins import EXPERIMENT, LOADED_BEFORE, loans, moment, oracle, runs, table
from loanline.schemas import FEATURES, KEYS, ORDINAL_CATEGORIES
from loanline.sources import project_features, work_folder

_TEXTS = ["credit_history", "purpose", "other_credit", "housing", "job", "phone"]
NUMBERS = [
    "months_loan_duration",
    "amount",
    "percent_of_income",
    "years_at_residence",
    "age",
    "existing_loans_count",
    "dependents",
]


def _cleaned_sql(column: str, unit: str) -> str:
    stripped = rf"trim(regexp_replace({column}, '\s*{unit}\s*$', ''))"
    return f"CASE WHEN {stripped} = '' THEN 'unknown' ELSE {stripped} END AS {column}"


CLEANED_TEXTS = ", ".join(
    [
        _cleaned_sql("checking_balance", "DM"),
        _cleaned_sql("savings_balance", "DM"),
        _cleaned_sql("employment_duration", "years?"),
        *[f"CASE WHEN {c} = '' THEN 'unknown' ELSE {c} END AS {c}" for c in _TEXTS],
    ]
)
INCOME = """CASE WHEN percent_of_income > 0 AND months_loan_duration > 0 THEN
  round((CAST(amount AS DOUBLE) / CAST(months_loan_duration AS DOUBLE))
    * (CAST(100 AS DOUBLE) / CAST(percent_of_income AS DOUBLE)), 2) END"""
LABEL = """CASE WHEN "default" = 'yes' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"""
CLEANED = f"""SELECT id, start_date, end_date, {", ".join(NUMBERS)}, {CLEANED_TEXTS},
 {LABEL} AS label, {INCOME} AS monthly_income FROM loans"""


def ordinal_sql(column: str) -> str:
    listed = ORDINAL_CATEGORIES[column]
    cases = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(listed))
    return f"CAST(CASE {column} {cases} ELSE {len(listed)} END AS DOUBLE) AS {column}"


ORDINALS = ", ".join(ordinal_sql(c) for c in ORDINAL_CATEGORIES)


def unit_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.unit_cleanup(project_features(loans(spark, sf_dir), keys=["id"]))
    return rows.select("id", "checking_balance", "savings_balance", "employment_duration", *_TEXTS)


def label_and_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.prepare(project_features(loans(spark, sf_dir), keys=["id"]))
    return rows.select("id", "label", "monthly_income")


def strict_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loans(spark, sf_dir).select("id", cleaning.strict_label("default").alias("y"))


def ordinal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordinal_encode(cleaning.unit_cleanup(project_features(loans(spark, sf_dir), keys=["id"])))
    return rows.select("id", *ORDINAL_CATEGORIES)


def preprocess_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row-wise step in order: the flagship query."""
    return run_steps(project_features(loans(spark, sf_dir), keys=KEYS))


def preprocess_steps_switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_steps(project_features(loans(spark, sf_dir), keys=["id"]), {"ordinal_encoding": False})
    return rows.select("id", "checking_balance", "label", "monthly_income")


def _text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans as they arrive in text: some shares and durations are no numbers."""
    raw = loans(spark, sf_dir)
    texts = {c: F.col(c).cast("string") for c in FEATURES}
    texts["percent_of_income"] = F.when(F.col("housing") == "other", "n/a").otherwise(texts["percent_of_income"])
    texts["amount"] = F.when(F.col("amount") > 300000, F.concat("amount", F.lit(" DM"))).otherwise(texts["amount"])
    return raw.select("id", *[c.alias(n) for n, c in texts.items()])


_TEXT_RECORDS = """SELECT id, savings_balance,
 CASE WHEN housing = 'other' THEN 'n/a' ELSE CAST(percent_of_income AS VARCHAR) END AS percent_of_income,
 CASE WHEN amount > 300000 THEN amount || ' DM' ELSE CAST(amount AS VARCHAR) END AS amount, age FROM loans"""
_REASON = """concat_ws('; ',
 CASE WHEN amount IS NULL THEN 'amount: missing' WHEN TRY_CAST(amount AS INTEGER) IS NULL THEN 'amount: not int' END,
 CASE WHEN savings_balance IS NULL THEN 'savings_balance: missing' END,
 CASE WHEN TRY_CAST(percent_of_income AS INTEGER) IS NULL THEN 'percent_of_income: not int' END)"""


def schema_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.quarantined_rows(cleaning.typed_records(_text_records(spark, sf_dir))).select(
        "id", "amount", "percent_of_income", "reason"
    )


def schema_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = cleaning.valid_rows(cleaning.typed_records(_text_records(spark, sf_dir)))
    return valid.select("id", "amount", "savings_balance", "percent_of_income", "age")


def runs_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on three columns."""
    same = (
        (F.col("model_type") == "xgboost")
        & (F.col("experiment_name") == f"{EXPERIMENT}_XGB")
        & (F.col("params")["criterion"] == "gini")
    )
    return runs(spark, sf_dir).filter(same).select("run_id", "run_name")


def runs_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring of the run name; one type's name starts another's."""
    return name_contains(runs(spark, sf_dir), "gradient_boosting").select("run_id", "run_name")


def runs_with_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = of_type(runs(spark, sf_dir), "random_forest")
    return with_metric(typed, "test_roc_auc").select("run_id", metric("metrics", "test_roc_auc").alias("value"))


def runs_above_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = above_thresholds(runs(spark, sf_dir), {"test_f1": 0.5, "test_recall": 0.005, "test_roc_auc": 0.2})
    return found.select("run_id", metric("metrics", "test_f1").alias("test_f1"))


def metric_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = with_default(metric("metrics", "test_roc_auc"))
    return runs(spark, sf_dir).select("run_id", value.alias("primary_metric_value"))


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(
        "run_id",
        short_name("model_type").alias("short_name"),
        model_name("main", "loans", "scorer", "model_type").alias("model_name"),
        experiment_name(EXPERIMENT, "model_type").alias("experiment_name"),
        run_name("loan", "model_type", F.concat(F.lit("run_"), F.col("user_id").cast("string"))).alias("run_name"),
        endpoint_name("loan_scorer", "model_type").alias("endpoint"),
    )


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-table rows of the earlier load, each key present twice."""
    early = loans(spark, sf_dir).filter(F.col("start_date") < moment(LOADED_BEFORE)).select(*KEYS, "amount")
    return early.union(early)


_LOADED = f"SELECT * FROM loans WHERE start_date < TIMESTAMP '{LOADED_BEFORE}'"


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = new_records(loans(spark, sf_dir), _loaded(spark, sf_dir), null_safe=False)
    return found.select(*KEYS, "amount")


def new_rows_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_records(loans(spark, sf_dir), _loaded(spark, sf_dir)).select(*KEYS, "amount")


def key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct business keys of order lines, where keys repeat."""
    return distinct_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def input_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-row sample kept beside a model."""
    return project_features(loans(spark, sf_dir), keys=["id"]).orderBy("id").limit(5)


def _new(operator: str) -> str:
    same = " AND ".join(f"e.{k} {operator} l.{k}" for k in KEYS)
    return oracle(
        f"SELECT {', '.join(KEYS)}, amount FROM loans l WHERE NOT EXISTS (SELECT 1 FROM loaded e WHERE {same})",
        "loans",
        loaded=_LOADED,
    )



_MONTH = {"month": "date_format(start_date, 'yyyy-MM')"}


def indexed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early loans as a history by month, then two increments over all loans; the second adds nothing."""
    raw, folder = loans(spark, sf_dir).select(*KEYS, "amount"), work_folder(spark, "history")
    added = [append_new(spark, rows, folder, KEYS, _MONTH) for rows in (raw.filter(F.col("start_date") < moment(LOADED_BEFORE)), raw, raw)]
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.select(*KEYS, "amount", F.date_format("start_date", "yyyy-MM").alias("month"), F.lit("-".join(map(str, added))).alias("added"))


QUERIES = {
    "indexed_history": (
        indexed_history,
        oracle(
            f"""SELECT id, start_date, end_date, amount, strftime(start_date, '%Y-%m') AS month,
 count(*) FILTER (start_date < TIMESTAMP '{LOADED_BEFORE}') OVER () || '-'
 || count(*) FILTER (start_date >= TIMESTAMP '{LOADED_BEFORE}') OVER () || '-0' AS added FROM loans""",
            "loans",
        ),
    ),
    "unit_cleanup": (unit_cleanup, oracle(f"SELECT id, {CLEANED_TEXTS} FROM loans", "loans")),
    "label_and_income": (
        label_and_income,
        oracle(f"SELECT id, {LABEL} AS label, {INCOME} AS monthly_income FROM loans", "loans"),
    ),
    "strict_label": (
        strict_label,
        oracle("SELECT id, CASE \"default\" WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS y FROM loans", "loans"),
    ),
    "ordinal_codes": (
        ordinal_codes,
        oracle(f"SELECT id, {ORDINALS} FROM cleaned", "loans", cleaned=CLEANED),
    ),
    "preprocess_steps": (
        preprocess_steps,
        oracle(
            f"SELECT id, start_date, end_date, {', '.join(NUMBERS)}, {', '.join(_TEXTS[1:])}, {ORDINALS}, label, "
            "monthly_income FROM cleaned",
            "loans",
            cleaned=CLEANED,
        ),
    ),
    "preprocess_steps_switched": (
        preprocess_steps_switched,
        oracle("SELECT id, checking_balance, label, monthly_income FROM cleaned", "loans", cleaned=CLEANED),
    ),
    "schema_quarantine": (
        schema_quarantine,
        oracle(
            f"SELECT id, TRY_CAST(amount AS INTEGER) AS amount, TRY_CAST(percent_of_income AS INTEGER) AS "
            f"percent_of_income, {_REASON} AS reason FROM texts WHERE {_REASON} <> ''",
            "loans",
            texts=_TEXT_RECORDS,
        ),
    ),
    "schema_valid": (
        schema_valid,
        oracle(
            "SELECT id, CAST(amount AS INTEGER) AS amount, savings_balance, CAST(percent_of_income AS INTEGER) AS "
            f"percent_of_income, age FROM texts WHERE {_REASON} = ''",
            "loans",
            texts=_TEXT_RECORDS,
        ),
    ),
    "runs_matching": (
        runs_matching,
        oracle(
            f"SELECT run_id, run_name FROM runs WHERE model_type = 'xgboost' AND experiment_name = '{EXPERIMENT}_XGB' "
            "AND criterion = 'gini'",
            "runs",
        ),
    ),
    "runs_by_name": (
        runs_by_name,
        oracle("SELECT run_id, run_name FROM runs WHERE contains(run_name, 'gradient_boosting')", "runs"),
    ),
    "runs_with_metric": (
        runs_with_metric,
        oracle(
            "SELECT run_id, test_roc_auc AS value FROM runs WHERE model_type = 'random_forest' "
            "AND test_roc_auc IS NOT NULL",
            "runs",
        ),
    ),
    "runs_above_thresholds": (
        runs_above_thresholds,
        oracle(
            "SELECT run_id, test_f1 FROM runs WHERE test_f1 >= CAST(0.5 AS DOUBLE) "
            "AND test_recall >= CAST(0.005 AS DOUBLE) AND test_roc_auc >= CAST(0.2 AS DOUBLE)",
            "runs",
        ),
    ),
    "metric_default": (
        metric_default,
        oracle("SELECT run_id, coalesce(test_roc_auc, CAST(0 AS DOUBLE)) AS primary_metric_value FROM runs", "runs"),
    ),
    "model_names": (
        model_names,
        oracle(
            "SELECT run_id, split_part(experiment_name, '_', 3) AS short_name, model_name, experiment_name, "
            "'loan_' || model_type || '_run_' || user_id AS run_name, 'loan-scorer-' || model_type || '-prod' "
            "AS endpoint FROM runs",
            "runs",
        ),
    ),
    "new_records": (new_rows, _new("=")),
    "new_records_null_safe": (new_rows_null_safe, _new("IS NOT DISTINCT FROM")),
    "distinct_keys": (key_set, "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem"),
    "input_example": (
        input_example,
        oracle(f"SELECT id, {', '.join(FEATURES)}, \"default\" AS label FROM loans ORDER BY id LIMIT 5", "loans"),
    ),
}
