"""Micro-batch ingest, exclusion and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loanline.plans.preprocessing import Preprocessor, run_steps
from loanline.plans.settings import EXPERIMENTS
from loanline.plans.training import split_raw, train_on_raw
from loanline.queries.cleaning import CLEANED
from loanline.queries.encoding import EARLY, scaled_sql, spread
from loanline.queries.standins import (
    EXPERIMENT,
    LOADED_BEFORE,
    LOGGED_BEFORE,
    loans,
    loans_from,
    moment,
    now,
    oracle,
    table,
)
from loanline.schemas import FEATURES, KEYS
from loanline.sources import project_features, read_signature, scan, work_folder
from loanline.streaming import ingest_stream, new_against_fixed, score_stream, score_stream_measured, stream_metrics


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table's file as a stream source."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive as a stream and are coded by models fitted on the early loans and saved.

    The stream is run twice with separate checkpoints: the second run sees every row again
    and adds none.
    """
    target, models = work_folder(spark, "stream"), work_folder(spark, "models")
    rows = project_features(loans(spark, sf_dir), keys=KEYS)
    Preprocessor.fit(rows.filter(F.col("start_date") < moment(LOADED_BEFORE)), impute="mean").save(models)
    fitted = Preprocessor.load(models)
    schema = fitted.apply(rows, KEYS).schema
    for turn in range(2):
        arriving = loans_from(stream(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))
        query = ingest_stream(
            project_features(arriving, keys=KEYS), target, work_folder(spark, "checkpoint"),
            lambda batch: fitted.apply(batch, KEYS), schema, stream_id=f"orders-{turn}",
        )
        query.awaitTermination()
    stored = scan(spark, target, schema)
    # Slot names live in the fitted schema; files carry the values.
    return spread(stored.withMetadata("features", schema["features"].metadata), [*KEYS, "label"])


def stream_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of user and type fill one table; a key stays as the first stream has it. A replay adds nothing."""
    target = work_folder(spark, "streams")
    schema = StructType.fromDDL("user_id long, event_type string, event_id long")
    shown = F.col("event_type").isin("click", "view")
    for name, kept, offset in (("early", shown, 0), ("late", F.lit(True), 1_000_000), ("replay", shown, 2_000_000)):
        arriving = stream(spark, sf_dir, "events").filter(kept)
        rows = arriving.select(F.col("user_id").cast("long"), "event_type", (F.col("event_id").cast("long") + offset).alias("event_id"))
        query = ingest_stream(
            rows, target, work_folder(spark, "checkpoint"), lambda batch: batch, schema, ["user_id", "event_type"], stream_id=name
        )
        query.awaitTermination()
    return scan(spark, target).select("user_id", "event_type", "event_id")


def _sink(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Drain a stream into a file sink and read it back."""
    target = work_folder(spark, "sink")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", work_folder(spark, "checkpoint"))
    writer.trigger(availableNow=True).start(target).awaitTermination()
    return scan(spark, target, rows.schema)


def stream_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users and types not seen before a fixed moment."""
    seen = table(spark, sf_dir, "events").filter(F.col("ts") < moment(LOGGED_BEFORE))
    fresh = new_against_fixed(stream(spark, sf_dir, "events"), seen, ["user_id", "event_type"])
    return _sink(fresh.select("event_id", "user_id", "event_type"), spark)


def stream_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row-wise steps run unchanged on a stream."""
    arriving = loans_from(stream(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))
    rows = run_steps(project_features(arriving, keys=["id"]), {"ordinal_encoding": False})
    return _sink(rows.select("id", "employment_duration", "label", "monthly_income"), spark)


def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model trained on the stored loans scores loans as they arrive."""
    settings = {"lr_baseline": EXPERIMENTS["logistic_regression"]["lr_baseline"]}
    split = split_raw(loans(spark, sf_dir), "id")
    _, models = train_on_raw(spark, split, "logistic_regression", settings, EXPERIMENT, work_folder(spark, "models"))
    arriving = loans_from(stream(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))
    target = work_folder(spark, "scored")
    query = score_stream(
        arriving, next(iter(models.values())), FEATURES, target, work_folder(spark, "checkpoint"),
        F.lit("logistic_regression"), F.lit("loan-scorer-logistic_regression-prod"), now(),
    )
    query.awaitTermination()
    return scan(spark, target)


def measured_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of loans scored with metrics, one started twice; their cells against a count over all results."""
    split = split_raw(loans(spark, sf_dir), "id")
    settings = {"lr_baseline": EXPERIMENTS["logistic_regression"]["lr_baseline"]}
    runs, models = train_on_raw(spark, split, "logistic_regression", settings, EXPERIMENT, work_folder(spark, "models"))
    model, signature = next(iter(models.values())), read_signature(spark, runs.first()["model_uri"])
    target, metrics = work_folder(spark, "scored"), work_folder(spark, "metrics")
    places = {name: work_folder(spark, "checkpoint") for name in ("open", "closed")}
    for name in ("open", "closed", "open"):
        orders = stream(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") == F.lit(name == "open"))
        arriving = loans_from(orders, table(spark, sf_dir, "customer"))
        score_stream_measured(
            arriving, model, FEATURES, target, metrics, places[name], F.lit("logistic_regression"),
            F.lit("loan-scorer-logistic_regression-prod"), now(), stream_id=name, signature=signature,
        ).awaitTermination()
    found = stream_metrics(spark, metrics, ["stream_id"])
    labelled = scan(spark, target).select("stream_id", (F.col("default") == "yes").alias("yes"), (F.col("prediction") == 1).alias("said"))
    again = labelled.groupBy("stream_id").agg(
        F.count_if(F.col("yes") & F.col("said")).alias("tp2"), F.count_if(F.col("yes") == F.col("said")).alias("right")
    )
    gap = F.abs(F.col("tp") - F.col("tp2")) + F.abs(F.col("tp") + F.col("tn") - F.col("right"))
    return found.join(again, "stream_id").select(
        "stream_id", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"), "unscored", gap.alias("gap")
    )


QUERIES = {
    "stream_metrics": (
        measured_stream,
        oracle(
            """SELECT CASE WHEN end_date IS NULL THEN 'open' ELSE 'closed' END AS stream_id,
 count(*) FILTER ("default" = 'yes') AS positives, count(*) FILTER ("default" = 'no') AS negatives,
 CAST(0 AS BIGINT) AS unscored, CAST(0 AS BIGINT) AS gap FROM loans GROUP BY 1""",
            "loans",
        ),
    ),
    "stream_incremental": (incremental_stream, scaled_sql(KEYS, EARLY, True)),
    "stream_two_sources": (
        stream_two_sources,
        """SELECT CAST(user_id AS BIGINT) AS user_id, event_type,
 min(CAST(event_id AS BIGINT)) + CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1000000 END AS event_id
FROM events GROUP BY user_id, event_type""",
    ),
    "stream_exclusion": (
        stream_exclusion,
        f"""SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s
WHERE s.ts < TIMESTAMP '{LOGGED_BEFORE}' AND s.user_id = e.user_id AND s.event_type = e.event_type)""",
    ),
    "stream_cleaning": (
        stream_cleaning,
        oracle("SELECT id, employment_duration, label, monthly_income FROM cleaned", "loans", cleaned=CLEANED),
    ),
    "stream_scoring": (stream_scoring, None),
}
