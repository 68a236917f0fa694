"""Indexing, one-hot vectors, scaling and splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.operators.cleaning import unit_cleanup
from loanline.operators.encoding import category_index, fit_one_hot, fit_training_features, one_hot, slot_names
from loanline.operators.hyperparams import zip_params
from loanline.operators.splitting import stratified_split
from loanline.plans.preprocessing import Preprocessor, full_load, incremental_load
from loanline.queries.cleaning import CLEANED, ORDINALS, NUMBERS
from loanline.queries.standins import LOADED_BEFORE, loans, moment, oracle, table
from loanline.schemas import FEATURES, KEYS, NOMINAL, ORDINAL_CATEGORIES
from loanline.sources import project_features, scan, work_folder

_CATEGORIES = {
    "purpose": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "other_credit": ["bank", "none", "store"],
    "housing": ["other", "own", "rent"],
    "job": ["management", "skilled", "unemployed", "unskilled"],
    "phone": ["no", "yes"],
}
_SCALED = [*ORDINAL_CATEGORIES, *NUMBERS, "monthly_income"]


def _slot(column: str) -> str:
    """A slot name as a plain column name."""
    return column.replace("_filled", "").replace("_vec_", "_is_").lower()


def spread(df: DataFrame, keep: list[str], vector: str = "features") -> DataFrame:
    """One rounded column per slot of the vector."""
    names = slot_names(df, vector)
    values = df.select(*keep, vector_to_array(vector).alias("slots"))
    return values.select(*keep, *[F.round(F.get("slots", F.lit(i)), 6).alias(_slot(n)) for i, n in enumerate(names)])


def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_index(loans(spark, sf_dir), NOMINAL)


def one_hot_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the one of each loan's purpose sits, from vectors fitted on loans with phones."""
    rows = unit_cleanup(project_features(loans(spark, sf_dir), keys=["id"]))
    fitted = fit_one_hot(rows.filter(F.col("job") != "unskilled"))
    found = one_hot(rows, fitted)
    place = {c: F.array_position(vector_to_array(f"{c}_vec"), 1.0) - 1 for c in ("purpose", "job")}
    return found.select(
        "id", *[v.alias(f"{c}_slot") for c, v in place.items()], F.size(vector_to_array("job_vec")).alias("job_width")
    )


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_features(loans(spark, sf_dir), keys=KEYS)


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features one-hot encoded, assembled and standardised; a missing income is the mean."""
    rows = _feature_rows(spark, sf_dir)
    return spread(Preprocessor.fit(rows, impute="mean").apply(rows, ["id"]), ["id", "label"])


def feature_vectors_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over loans that have an income."""
    rows = _feature_rows(spark, sf_dir)
    return spread(Preprocessor.fit(rows, invalid="skip").apply(rows, ["id"]), ["id", "label"])


def preprocess_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps but scaling: codes, vectors and numbers as they are, the switches saved and read back."""
    folder, rows = work_folder(spark, "transforms"), _feature_rows(spark, sf_dir)
    Preprocessor.fit(rows, enabled={"scaling": False}).save(folder)
    found = Preprocessor.load(folder).apply(rows, ["id"])
    slot = (F.array_position(vector_to_array("purpose_vec"), 1.0) - 1).alias("purpose_slot")
    return found.select("id", *ORDINAL_CATEGORIES, *NUMBERS, "monthly_income", "label", slot)


def preprocess_without_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps but one-hot: the nominal texts stay beside the vector of codes and numbers."""
    rows = _feature_rows(spark, sf_dir)
    found = Preprocessor.fit(rows, impute="mean", enabled={"one_hot": False}).apply(rows, ["id"])
    return spread(found, ["id", "label", "purpose"])


def saved_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on loans loaded earlier, saved, read back and applied to all loans."""
    folder = work_folder(spark, "transforms")
    rows = _feature_rows(spark, sf_dir)
    Preprocessor.fit(rows.filter(F.col("start_date") < moment(LOADED_BEFORE)), impute="mean").save(folder)
    return spread(Preprocessor.load(folder).apply(rows, ["id"]), ["id", "label"])


def incremental_preprocessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full load of the early loans, then two increments over all of them; the second adds nothing."""
    target, models = work_folder(spark, "features"), work_folder(spark, "models")
    raw = loans(spark, sf_dir)
    full_load(raw.filter(F.col("start_date") < moment(LOADED_BEFORE)), target, models, KEYS, impute="mean")
    incremental_load(spark, raw, target, models)
    incremental_load(spark, raw, target, models)
    return spread(scan(spark, target), [*KEYS, "label"])


def training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loans(spark, sf_dir).select("id", *FEATURES)
    fitted = fit_training_features(rows, FEATURES)
    values = vector_to_array("numbers_scaled")
    numbers = [F.round(values[i], 6).alias(c) for i, c in enumerate(NUMBERS)]
    slots = {c: F.array_position(vector_to_array(f"{c}_vec"), 1.0) - 1 for c in ("savings_balance", "credit_history")}
    return fitted.transform(rows).select(
        "id", *numbers, *[v.alias(f"{c}_slot") for c, v in slots.items()], F.size(vector_to_array("features")).alias("width")
    )


def split_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = stratified_split(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")
    return split.select("o_orderkey", "o_orderstatus", "split")


def split_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    split = stratified_split(orders, "o_orderpriority", "o_orderkey", {"test": 0.2, "validation": 0.1})
    return split.select("o_orderkey", "split")


def zipped_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a grid: all its values, its distinct tenths, and its one label."""
    values = F.transform("embedding", lambda x: F.floor(x * 1000).cast("int").cast("string"))
    tenths = F.array_sort(F.array_distinct(F.transform("embedding", lambda x: F.floor(x * 10).cast("int").cast("string"))))
    lists = F.create_map(
        F.lit("learning_rate"), values, F.lit("max_depth"), tenths, F.lit("seed"), F.array(F.col("label").cast("string"))
    )
    grids = table(spark, sf_dir, "embeddings").select("vec_id", lists.alias("lists"))
    keys = ("learning_rate", "max_depth", "seed")
    return zip_params(grids).select("vec_id", "run", *[F.col("params")[k].alias(k) for k in keys])


def _index_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", {column} AS value, count(*) AS n,
 CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS INTEGER) AS "index"
FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}"""


def scaled_sql(keys: list[str], fit_where: str, impute: bool, where: str = "") -> str:
    """Standardised columns, by mean and sample deviation over the fitted rows."""
    income = "coalesce(monthly_income, (SELECT avg(monthly_income) FROM fitted))" if impute else "monthly_income"
    plain = [c for c in _SCALED if c != "monthly_income"]
    flags = {
        f"{c}_is_{v}".lower(): f"CAST({c} = '{v}' AS INTEGER)" for c, listed in _CATEGORIES.items() for v in listed
    }
    numeric = ", ".join(
        [*[f"CAST({c} AS DOUBLE) AS {c}" for c in plain], f"{income} AS monthly_income"]
        + [f"CAST({e} AS DOUBLE) AS {n}" for n, e in flags.items()]
    )
    names = [*_SCALED, *flags]
    moments = ", ".join(f"avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}" for n in names)
    scaled = ", ".join(
        f"round(CASE WHEN s_{n} = 0 THEN 0 ELSE (a.{n} - m_{n}) / s_{n} END, 6) + CAST(0 AS DOUBLE) AS {n}"
        for n in names
    )
    nominal = ", ".join(NOMINAL)
    numbers = ", ".join(NUMBERS)
    return oracle(
        f"SELECT {', '.join(keys)}, label, {scaled} FROM every a, moments {where}",
        "loans",
        cleaned=CLEANED,
        coded=f"SELECT id, start_date, end_date, {ORDINALS}, {numbers}, {nominal}, label, monthly_income FROM cleaned",
        fitted=f"SELECT * FROM coded WHERE {fit_where}",
        every=f"SELECT id, start_date, end_date, purpose, label, {numeric} FROM coded",
        early="SELECT e.* FROM every e WHERE id IN (SELECT id FROM fitted)",
        moments=f"SELECT {moments} FROM early",
    )


EARLY = f"start_date < TIMESTAMP '{LOADED_BEFORE}'"


def _split_sql(label: str, parts: dict[str, float], columns: str) -> str:
    share, cases = 0.0, []
    for name, fraction in parts.items():
        share += fraction
        cases.append(f"WHEN place <= floor(CAST({share!r} AS DOUBLE) * total + CAST(0.5 AS DOUBLE)) THEN '{name}'")
    return f"""WITH drawn AS (SELECT *, row_number() OVER (PARTITION BY {label}
  ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42')) AS place, count(*) OVER (PARTITION BY {label}) AS total FROM orders)
SELECT {columns}, CASE {" ".join(cases)} ELSE 'train' END AS split FROM drawn"""


def _population_sql() -> str:
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMBERS)
    scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + CAST(0 AS DOUBLE) AS {c}" for c in NUMBERS)
    texts = [c for c in FEATURES if c not in NUMBERS]
    places = {
        c: f"""SELECT coalesce({c}, '(null)') AS v, row_number() OVER (ORDER BY count(*) DESC, coalesce({c}, '(null)')) - 1 AS p
FROM loans GROUP BY coalesce({c}, '(null)')"""
        for c in ("savings_balance", "credit_history")
    }
    width = " + ".join(f"count(DISTINCT coalesce({c}, '(null)'))" for c in texts)
    return oracle(
        f"""SELECT id, {scaled}, s.p AS savings_balance_slot, h.p AS credit_history_slot,
 CAST((SELECT {width} FROM loans) + {len(NUMBERS)} AS INTEGER) AS width
FROM loans l JOIN s ON coalesce(l.savings_balance, '(null)') = s.v JOIN h ON coalesce(l.credit_history, '(null)') = h.v, moments""",
        "loans",
        moments=f"SELECT {moments} FROM loans",
        s=places["savings_balance"],
        h=places["credit_history"],
    )


QUERIES = {
    "string_index": (string_index, oracle("\nUNION ALL\n".join(f"({_index_sql(c, 'loans')})" for c in NOMINAL), "loans")),
    "one_hot": (
        one_hot_slots,
        oracle(
            """SELECT l.id, p."index" AS purpose_slot, coalesce(j."index", -1) AS job_slot,
 CAST((SELECT count(*) FROM jobs) AS INTEGER) AS job_width
FROM loans l LEFT JOIN purposes p ON l.purpose = p.value LEFT JOIN jobs j ON l.job = j.value""",
            "loans",
            fitted="SELECT * FROM loans WHERE job <> 'unskilled'",
            purposes=_index_sql("purpose", "fitted").replace(" AS INTEGER)", " AS BIGINT)"),
            jobs=_index_sql("job", "fitted").replace(" AS INTEGER)", " AS BIGINT)"),
        ),
    ),
    "feature_vectors": (feature_vectors, scaled_sql(["id"], "TRUE", True)),
    "feature_vectors_complete_rows": (
        feature_vectors_complete_rows,
        scaled_sql(["id"], "monthly_income IS NOT NULL", False, "WHERE monthly_income IS NOT NULL"),
    ),
    "preprocess_unscaled": (
        preprocess_unscaled,
        oracle(
            f"""SELECT id, {ORDINALS}, {", ".join(NUMBERS)}, monthly_income, label, p."index" AS purpose_slot
FROM cleaned JOIN purposes p ON purpose = p.value""",
            "loans",
            cleaned=CLEANED,
            purposes=_index_sql("purpose", "loans").replace(" AS INTEGER)", " AS BIGINT)"),
        ),
    ),
    "preprocess_without_one_hot": (
        preprocess_without_one_hot,
        f"SELECT id, label, purpose, {', '.join(_SCALED)} FROM ({scaled_sql(['id', 'purpose'], 'TRUE', True)}) q",
    ),
    "saved_transforms": (saved_transforms, scaled_sql(["id"], EARLY, True)),
    "incremental_preprocessing": (
        incremental_preprocessing,
        scaled_sql(KEYS, EARLY, True),
    ),
    "training_features": (training_features, _population_sql()),
    "stratified_split": (split_test, _split_sql("o_orderstatus", {"test": 0.2}, "o_orderkey, o_orderstatus")),
    "stratified_split_three_ways": (
        split_three_ways,
        _split_sql("o_orderpriority", {"test": 0.2, "validation": 0.1}, "o_orderkey"),
    ),
    "zip_params": (
        zipped_settings,
        """WITH lists AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER) AS VARCHAR)) AS a,
  list_sort(list_distinct(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 10) AS INTEGER) AS VARCHAR)))) AS b
  FROM embeddings)
SELECT vec_id, CAST(run AS INTEGER) AS run, a[run] AS learning_rate, coalesce(b[run], b[-1]) AS max_depth,
 CAST(label AS VARCHAR) AS seed FROM (SELECT *, unnest(range(1, len(a) + 1)) AS run FROM lists)""",
    ),
}
