"""Scoring a stream of raw rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loanline.operators.metrics import confusion_cells, ratios
from loanline.operators.scoring import inference_rows, score
from loanline.schemas import LABEL
from loanline.sources.tables import replace_keys, scan
from loanline.streaming.ingest import BATCH, STREAM, bind_checkpoint

_CELLS = ["tn", "fp", "fn", "tp", "unscored"]


def score_stream(
    stream: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    target: str,
    checkpoint: str,
    model_type: Column,
    endpoint: Column,
    when: Column,
    signature: StructType | None = None,
) -> StreamingQuery:
    """Append a result row for every row that arrives; the file sink writes each row once.

    With the model's ``signature`` the types of the columns are checked before the stream starts.
    """
    rows = inference_rows(score(stream, model, features, signature), model_type, endpoint, when)
    writer = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start(target)


def measured_batches(
    model: PipelineModel,
    features: Sequence[str],
    target: str,
    metrics: str,
    model_type: Column,
    endpoint: Column,
    when: Column,
    stream_id: str,
    label: str = LABEL,
) -> Callable[[DataFrame, int], None]:
    """What is done with each micro-batch: its results and their confusion cells replace those of its stream and number.

    A batch that is run again after a failure is neither stored nor counted twice; the cells are counted over the stored
    results, so that both tables agree whenever a job dies. Rows without a yes/no label count as unscored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        names = {STREAM: F.lit(stream_id), BATCH: F.lit(batch_id).cast("bigint")}
        rows = inference_rows(score(batch, model, features), model_type, endpoint, when).withColumns(names)
        if not replace_keys(rows, target, [STREAM, BATCH]):
            return
        own = (F.col(STREAM) == stream_id) & (F.col(BATCH) == batch_id)
        truth = F.when(F.col(label) == "yes", 1).when(F.col(label) == "no", 0)
        stored = scan(batch.sparkSession, target, rows.schema).filter(own)
        cells = stored.groupBy(STREAM, BATCH).agg(*confusion_cells(truth, F.col("prediction"), unscored=True))
        replace_keys(cells.coalesce(1), metrics, [STREAM, BATCH])

    return write


def score_stream_measured(
    stream: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    target: str,
    metrics: str,
    checkpoint: str,
    model_type: Column,
    endpoint: Column,
    when: Column,
    *,
    stream_id: str,
    signature: StructType | None = None,
    label: str = LABEL,
) -> StreamingQuery:
    """``score_stream`` with metrics: ``target`` and ``metrics`` are partitioned by ``stream_id`` and ``batch_id``."""
    score(stream, model, features, signature)  # fails before anything is written
    bind_checkpoint(stream.sparkSession, target, stream_id, checkpoint)
    write = measured_batches(model, features, target, metrics, model_type, endpoint, when, stream_id, label)
    writer = stream.writeStream.foreachBatch(write).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint).start()


def stream_metrics(spark: SparkSession, metrics: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of all measured batches, or of each stream with ``by=["stream_id"]``."""
    schema = ", ".join([*(f"{c} bigint" for c in _CELLS), f"{STREAM} string", f"{BATCH} bigint"])
    cells = scan(spark, metrics, StructType.fromDDL(schema)).groupBy(*by).agg(*[F.sum(c).alias(c) for c in _CELLS])
    return ratios(cells, [*by], ["unscored"])
