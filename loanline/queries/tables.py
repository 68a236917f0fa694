"""Sources, sinks and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.functions import canonical_json, pick_all, pick_present
from loanline.queries.standins import loans, moment, oracle, table, LOADED_BEFORE
from loanline.schemas import FEATURES, KEYS, LOAN_TABLE
from loanline.sources import (
    append,
    create_if_missing,
    overwrite,
    project_features,
    read_buckets,
    read_evolved,
    replace_in_buckets,
    scan,
    work_folder,
)

_COLUMNS = ", ".join([*KEYS, *FEATURES])
_DEFAULT = '"default"'


def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_features(loans(spark, sf_dir), keys=KEYS)


def table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = work_folder(spark, "overwrite")
    raw = loans(spark, sf_dir)
    overwrite(raw.filter(F.col("default") == "yes"), target)
    overwrite(raw, target)
    return scan(spark, target, LOAN_TABLE)


def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = work_folder(spark, "append")
    raw = loans(spark, sf_dir)
    create_if_missing(spark, target, LOAN_TABLE)
    append(raw.filter(F.col("start_date") < moment(LOADED_BEFORE)), target)
    create_if_missing(spark, target, LOAN_TABLE)
    append(raw.filter(F.col("start_date") >= moment(LOADED_BEFORE)), target)
    return scan(spark, target, LOAN_TABLE)


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early orders are stored without their priority, later ones with it."""
    target = work_folder(spark, "evolve")
    orders = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < moment(LOADED_BEFORE)
    append(orders.filter(early).drop("o_orderpriority"), target)
    append(orders.filter(~early), target)
    return read_evolved(spark, target).select("o_orderkey", "o_totalprice", "o_orderpriority")


def keyed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all documents per (language, source); those with labelled documents are redone."""
    target = work_folder(spark, "replace")
    keys = ["model_name", "model_version"]
    sources = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("model_name"), F.col("source").alias("model_version"), "n_chars"
    )
    found = [F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters")]
    replace_in_buckets(sources.groupBy(*keys).agg(*found), target, keys)
    labelled = sources.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    for _ in range(2):  # a rerun changes nothing
        replace_in_buckets(labelled.groupBy(*keys).agg(*found), target, keys)
    return read_buckets(spark, target)


def rows_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count each write reports, for loans with and without a known end."""
    raw = loans(spark, sf_dir)
    open_rows = overwrite(raw.filter(F.col("end_date").isNull()), work_folder(spark, "count"))
    closed_rows = overwrite(raw.filter(F.col("end_date").isNotNull()), work_folder(spark, "count"))
    return spark.createDataFrame([(open_rows, closed_rows)], "open_rows bigint, closed_rows bigint")


def json_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as a map, with the event's type added, and its canonical texts."""
    props = F.from_json("props", "map<string,int>")
    merged = F.map_concat(F.create_map(F.lit("user"), F.col("user_id").cast("int")), props)
    return table(spark, sf_dir, "events").select("event_id", merged.alias("m")).select(
        "event_id",
        canonical_json("m").alias("all_json"),
        canonical_json(pick_present("m", ["k", "absent"])).alias("present_json"),
        canonical_json(pick_all("m", ["k", "absent"])).alias("filled_json"),
    )


QUERIES = {
    "feature_projection": (feature_projection, oracle(f"SELECT {_COLUMNS}, {_DEFAULT} AS label FROM loans", "loans")),
    "table_overwrite": (table_overwrite, oracle("SELECT * FROM loans", "loans")),
    "table_append": (table_append, oracle("SELECT * FROM loans", "loans")),
    "schema_evolution": (
        schema_evolution,
        "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate >= TIMESTAMP '"
        + LOADED_BEFORE
        + "' THEN o_orderpriority END AS o_orderpriority FROM orders",
    ),
    "keyed_replace": (
        keyed_replace,
        """WITH every AS (SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c
  FROM documents GROUP BY lang, source),
labelled AS (SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang, source)
SELECT e.lang AS model_name, e.source AS model_version, coalesce(l.n, e.n) AS documents,
 coalesce(l.c, e.c) AS characters
FROM every e LEFT JOIN labelled l ON e.lang = l.lang AND e.source = l.source""",
    ),
    "rows_written": (
        rows_written,
        oracle(
            "SELECT count(*) FILTER (WHERE end_date IS NULL) AS open_rows, "
            "count(*) FILTER (WHERE end_date IS NOT NULL) AS closed_rows FROM loans",
            "loans",
        ),
    ),
    "json_metrics": (
        json_metrics,
        """SELECT event_id,
 '{"k":' || json_extract_string(props, '$.k') || ',"user":' || user_id || '}' AS all_json,
 '{"k":' || json_extract_string(props, '$.k') || '}' AS present_json,
 '{"absent":null,"k":' || json_extract_string(props, '$.k') || '}' AS filled_json
FROM events""",
    ),
}
