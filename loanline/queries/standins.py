"""Loan, run, score, version, alias and acceptance records made from the test tables.

Each stand-in is a DataFrame function and, under the same name in VIEWS, the SQL that gives
the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.functions import canonical_json, experiment_name
from loanline.operators.registry import compared
from loanline.schemas import COMPARED_METRICS

Query = Callable[[SparkSession, str], DataFrame]

BASE_MODEL = "main.loans.scorer_"
EXPERIMENT = "loan_experiments"
NOW_TEXT = "2024-02-01 00:00:00"
# Runs that began before this were evaluated, logged and registered by earlier jobs.
LOGGED_BEFORE = "2024-01-02 00:00:00"
# Loans that began before this are in the feature table already.
LOADED_BEFORE = "1998-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def now() -> Column:
    return moment(NOW_TEXT)


def _pick(value: Column, *cases: tuple, otherwise) -> Column:
    column = F
    for wanted, result in cases:
        column = column.when(value == wanted, result)
    return column.otherwise(otherwise)


def loans_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    key, cust, nation = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    balance = F.col("c_acctbal")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"),
        F.col("o_orderdate").alias("start_date"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("end_date"),
        F.when(balance < 0, "< 0 DM")
        .when(balance <= 2000, "1 - 200 DM")
        .when(balance <= 8000, "> 200 DM")
        .otherwise("")
        .alias("checking_balance"),
        (6 + key % 60).cast("int").alias("months_loan_duration"),
        _pick(
            F.col("o_orderpriority"),
            ("1-URGENT", "critical"),
            ("2-HIGH", "poor"),
            ("3-MEDIUM", "good"),
            ("4-NOT SPECIFIED", "very good"),
            otherwise="perfect",
        ).alias("credit_history"),
        F.col("c_mktsegment").alias("purpose"),
        F.floor("o_totalprice").cast("int").alias("amount"),
        _pick(
            key % 6, (0, "< 100 DM"), (1, "100 - 500 DM"), (2, "500 - 1000 DM"), (3, "> 1000 DM"), (4, "unknown"),
            otherwise=None,
        ).alias("savings_balance"),
        _pick(
            key % 7, (0, "unemployed"), (1, "< 1 year"), (2, "1 - 4 years"), (3, "4 - 7 years"), (4, "> 7 years"),
            (5, "> 7 yrs"), otherwise="",
        ).alias("employment_duration"),
        (key % 5).cast("int").alias("percent_of_income"),
        (1 + cust % 4).cast("int").alias("years_at_residence"),
        (19 + cust % 55).cast("int").alias("age"),
        _pick(cust % 3, (0, "none"), (1, "bank"), otherwise="store").alias("other_credit"),
        _pick(nation % 3, (0, "own"), (1, "rent"), otherwise="other").alias("housing"),
        (1 + cust % 4).cast("int").alias("existing_loans_count"),
        _pick(nation % 4, (0, "skilled"), (1, "unskilled"), (2, "management"), otherwise="unemployed").alias("job"),
        (1 + cust % 2).cast("int").alias("dependents"),
        F.when(cust % 5 < 2, "yes").otherwise("no").alias("phone"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("default"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loans_from(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    model_type = _pick(
        F.col("event_type"),
        ("click", "random_forest"),
        ("view", "xgboost"),
        ("purchase", "logistic_regression"),
        ("error", "gradient_boosting_classifier"),
        otherwise="naive_bayes",
    )
    grouped = events.groupBy("user_id", "event_type").agg(
        F.min("ts").alias("start_time"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.floor(F.col("value") * 100)).alias("total"),
        F.floor(F.min("value")).alias("low"),
        F.floor(F.max("value")).alias("high"),
    )
    grouped = grouped.withColumn("model_type", model_type)
    values = {
        "test_accuracy": (F.col("low") * 2 + 500) / 1000,
        "test_precision": F.col("n") / 1000,
        "test_recall": F.expr("total DIV (n * 50)") / 1000,
        "test_f1": F.col("high") * 2 / 1000,
        "test_roc_auc": F.when(F.col("n") > 12, F.col("high") / 1000),
        "train_accuracy": (F.col("low") + 700) / 1000,
        "train_time": F.col("n") + F.lit(0.5),
        "inference_time": F.when(F.col("event_type") != "signup", F.col("n") / 100),
    }
    entries = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    user = F.col("user_id")
    params = F.create_map(
        F.lit("n_estimators"), F.lit("100"),
        F.lit("max_depth"), (10 + 5 * (user % 3)).cast("string"),
        F.lit("criterion"), F.when(user % 2 == 0, "gini").otherwise("entropy"),
    )
    run_id = F.concat(F.lit("run_"), user.cast("string"), F.lit("_"), F.col("event_type"))
    return grouped.select(
        run_id.alias("run_id"),
        F.concat(F.lit("loan_"), "model_type", F.lit("_exp_"), F.floor(user / 3).cast("string")).alias("run_name"),
        experiment_name(EXPERIMENT, "model_type").alias("experiment_name"),
        "model_type",
        "start_time",
        F.map_filter(entries, lambda _, v: v.isNotNull()).alias("metrics"),
        params.alias("params"),
        F.concat(F.lit("runs:/"), run_id, F.lit("/ml_model")).alias("model_uri"),
        "user_id",
        "n",
    )


def model_of(model_type: Column | str = "model_type") -> Column:
    return F.concat(F.lit(BASE_MODEL), model_type)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run as a version of its model."""
    return runs(spark, sf_dir).select(
        model_of().alias("model_name"),
        (F.col("user_id") + 1).cast("int").alias("version"),
        "run_id",
        F.when(F.col("n") < 8, "PENDING_REGISTRATION").otherwise("READY").alias("status"),
        F.col("start_time").alias("creation_timestamp"),
    )


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions registered by earlier jobs, with what duplicates are judged by."""
    earlier = runs(spark, sf_dir).filter(F.col("start_time") < moment(LOGGED_BEFORE))
    return earlier.select(
        model_of().alias("model_name"),
        (F.col("user_id") + 1).cast("int").alias("version"),
        "run_id",
        canonical_json("params").alias("params_json"),
        compared(COMPARED_METRICS).alias("compared"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging: the first version, but the best one for xgboost and none for naive_bayes."""
    recall = F.col("metrics")["test_recall"]
    ready = F.when(F.col("n") >= 8, F.struct(recall, -F.col("user_id"), "user_id"))
    staged = runs(spark, sf_dir).filter(F.col("model_type") != "naive_bayes").groupBy("model_type").agg(
        F.min("user_id").alias("first"), F.max(ready)["user_id"].alias("best")
    )
    chosen = F.when(F.col("model_type") == "xgboost", F.col("best")).otherwise(F.col("first"))
    return staged.select(
        model_of().alias("model_name"), F.lit("Staging").alias("alias"), (chosen + 1).cast("int").alias("version")
    )


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance results: one per event, for the version of the event's user."""
    model_type = runs(spark, sf_dir).select("run_id", "model_type", "user_id")
    run_id = F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_type"))
    events = table(spark, sf_dir, "events").withColumn("run_id", run_id).drop("user_id")
    share = F.floor("value") / 1000
    return events.join(model_type, "run_id").select(
        F.col("ts").alias("timestamp"),
        model_of().alias("model_name"),
        "model_type",
        (F.col("user_id") + 1).cast("string").alias("model_version"),
        "run_id",
        F.when(F.col("value") >= 20, "PASSED").otherwise("FAILED").alias("uat_status"),
        *[(share + step).alias(m) for m, step in ACCEPTANCE_STEPS.items()],
    )


ACCEPTANCE_STEPS = {"accuracy": 0.5, "precision": 0.25, "recall": 0.125, "f1": 0.0625, "roc_auc": 0.375}


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        F.col("quality").alias("y_true"),
        (1 - F.col("toxic")).alias("y_pred"),
        (F.col("n_chars").cast("double") / 20000).alias("score"),
    )


VIEWS = {
    "loans": """
SELECT o_orderkey AS id, o_orderdate AS start_date,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS end_date,
 CASE WHEN c_acctbal < 0 THEN '< 0 DM' WHEN c_acctbal <= 2000 THEN '1 - 200 DM'
      WHEN c_acctbal <= 8000 THEN '> 200 DM' ELSE '' END AS checking_balance,
 CAST(6 + o_orderkey % 60 AS INTEGER) AS months_loan_duration,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'poor' WHEN '3-MEDIUM' THEN 'good'
      WHEN '4-NOT SPECIFIED' THEN 'very good' ELSE 'perfect' END AS credit_history,
 c_mktsegment AS purpose, CAST(floor(o_totalprice) AS INTEGER) AS amount,
 CASE o_orderkey % 6 WHEN 0 THEN '< 100 DM' WHEN 1 THEN '100 - 500 DM' WHEN 2 THEN '500 - 1000 DM'
      WHEN 3 THEN '> 1000 DM' WHEN 4 THEN 'unknown' END AS savings_balance,
 CASE o_orderkey % 7 WHEN 0 THEN 'unemployed' WHEN 1 THEN '< 1 year' WHEN 2 THEN '1 - 4 years'
      WHEN 3 THEN '4 - 7 years' WHEN 4 THEN '> 7 years' WHEN 5 THEN '> 7 yrs' ELSE '' END AS employment_duration,
 CAST(o_orderkey % 5 AS INTEGER) AS percent_of_income,
 CAST(1 + o_custkey % 4 AS INTEGER) AS years_at_residence,
 CAST(19 + o_custkey % 55 AS INTEGER) AS age,
 CASE o_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'bank' ELSE 'store' END AS other_credit,
 CASE c_nationkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'rent' ELSE 'other' END AS housing,
 CAST(1 + o_custkey % 4 AS INTEGER) AS existing_loans_count,
 CASE c_nationkey % 4 WHEN 0 THEN 'skilled' WHEN 1 THEN 'unskilled' WHEN 2 THEN 'management'
      ELSE 'unemployed' END AS job,
 CAST(1 + o_custkey % 2 AS INTEGER) AS dependents,
 CASE WHEN o_custkey % 5 < 2 THEN 'yes' ELSE 'no' END AS phone,
 CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS "default"
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "grouped": """
SELECT user_id, event_type,
 CASE event_type WHEN 'click' THEN 'random_forest' WHEN 'view' THEN 'xgboost'
      WHEN 'purchase' THEN 'logistic_regression' WHEN 'error' THEN 'gradient_boosting_classifier'
      ELSE 'naive_bayes' END AS model_type,
 min(ts) AS start_time, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total,
 CAST(floor(min(value)) AS BIGINT) AS low, CAST(floor(max(value)) AS BIGINT) AS high
FROM events GROUP BY user_id, event_type""",
    "runs": f"""
SELECT 'run_' || user_id || '_' || event_type AS run_id,
 'loan_' || model_type || '_exp_' || (user_id // 3) AS run_name,
 '{EXPERIMENT}_' || CASE model_type WHEN 'random_forest' THEN 'RF' WHEN 'xgboost' THEN 'XGB'
   WHEN 'logistic_regression' THEN 'LR' WHEN 'naive_bayes' THEN 'NB' ELSE 'GBC' END AS experiment_name,
 model_type, start_time, user_id, n,
 CAST(low * 2 + 500 AS DOUBLE) / 1000 AS test_accuracy, CAST(n AS DOUBLE) / 1000 AS test_precision,
 CAST(total // (n * 50) AS DOUBLE) / 1000 AS test_recall, CAST(high * 2 AS DOUBLE) / 1000 AS test_f1,
 CASE WHEN n > 12 THEN CAST(high AS DOUBLE) / 1000 END AS test_roc_auc,
 CAST(low + 700 AS DOUBLE) / 1000 AS train_accuracy, CAST(n AS DOUBLE) + 0.5 AS train_time,
 CASE WHEN event_type <> 'signup' THEN CAST(n AS DOUBLE) / 100 END AS inference_time,
 CAST(10 + 5 * (user_id % 3) AS VARCHAR) AS max_depth,
 CASE WHEN user_id % 2 = 0 THEN 'gini' ELSE 'entropy' END AS criterion,
 '{{"criterion":"' || criterion || '","max_depth":"' || max_depth || '","n_estimators":"100"}}' AS params_json,
 '{BASE_MODEL}' || model_type AS model_name,
 'runs:/run_' || user_id || '_' || event_type || '/ml_model' AS model_uri
FROM grouped""",
    "versions": """
SELECT model_name, CAST(user_id + 1 AS INTEGER) AS version, run_id,
 CASE WHEN n < 8 THEN 'PENDING_REGISTRATION' ELSE 'READY' END AS status, start_time AS creation_timestamp
FROM runs""",
    "aliases": """
SELECT model_name, 'Staging' AS alias,
 CAST(1 + CASE WHEN model_type = 'xgboost'
   THEN first(user_id ORDER BY test_recall DESC, user_id) FILTER (WHERE n >= 8)
   ELSE min(user_id) END AS INTEGER) AS version
FROM runs WHERE model_type <> 'naive_bayes' GROUP BY model_name, model_type""",
    "acceptance": """
SELECT e.ts AS "timestamp", r.model_name, r.model_type, CAST(r.user_id + 1 AS VARCHAR) AS model_version, r.run_id,
 CASE WHEN e.value >= 20 THEN 'PASSED' ELSE 'FAILED' END AS uat_status,
 """
    + ", ".join(
        f"CAST(floor(e.value) AS DOUBLE) / 1000 + CAST({step} AS DOUBLE) AS {name}"
        for name, step in ACCEPTANCE_STEPS.items()
    )
    + """
FROM events e JOIN runs r ON r.run_id = 'run_' || e.user_id || '_' || e.event_type""",
    "scores": """
SELECT l.doc_id AS id, d.lang, d.source, l.quality AS y_true, 1 - l.toxic AS y_pred,
 CAST(d.n_chars AS DOUBLE) / CAST(20000 AS DOUBLE) AS score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}
NEEDS = {
    "runs": ["grouped"],
    "versions": ["grouped", "runs"],
    "aliases": ["grouped", "runs"],
    "acceptance": ["grouped", "runs"],
}


def oracle(body: str, *views: str, **extra: str) -> str:
    """SQL text with the named stand-ins, and further named parts, in front of the body."""
    names = list(dict.fromkeys(v for view in views for v in [*NEEDS.get(view, []), view]))
    parts = {**{v: VIEWS[v] for v in names}, **extra}
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    recursive = "RECURSIVE " if any("UNION ALL" in sql for sql in extra.values()) else ""
    return f"WITH {recursive}{head}\n{body}" if parts else body
