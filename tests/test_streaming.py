from __future__ import annotations

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from loanline.operators.incremental import new_records
from loanline.sources import scan
from loanline.streaming import ingest_stream, score_stream, score_stream_measured, stream_metrics
from loanline.streaming.scoring import measured_batches

_KEYS = [StructField("id", LongType()), StructField("part", StringType())]
SCHEMA = StructType([*_KEYS, StructField("v", IntegerType())])
OUT = StructType([*_KEYS, StructField("doubled", IntegerType())])


def _double(df):
    return df.select("id", "part", (F.col("v") * 2).alias("doubled"))


def _run(spark, source, folder, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    ingest_stream(stream, f"{folder}/out", f"{folder}/{checkpoint}", _double, OUT, ["id", "part"], stream_id=checkpoint).awaitTermination()
    return sorted(tuple(r) for r in scan(spark, f"{folder}/out").select("id", "part", "doubled").collect())


def test_each_key_is_appended_once(spark, folder):
    source = f"{folder}/in"
    rows = [(1, "a", 10), (1, "a", 10), (2, "a", 20)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    assert _run(spark, source, folder, "c1") == [(1, "a", 20), (2, "a", 40)]

    spark.createDataFrame([(2, "a", 99), (3, None, 30)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    after = [(1, "a", 20), (2, "a", 40), (3, None, 60)]
    assert sorted(_run(spark, source, folder, "c1"), key=str) == sorted(after, key=str)
    # a new checkpoint reads everything again and adds nothing
    assert sorted(_run(spark, source, folder, "c2"), key=str) == sorted(after, key=str)


def test_stream_equals_batch(spark, folder):
    source = f"{folder}/in"
    df = spark.range(200).selectExpr("id % 150 AS id", "'p' AS part", "CAST(id % 150 AS int) AS v").repartition(3)
    df.write.parquet(source)
    empty = spark.createDataFrame([], OUT)
    batch = _double(new_records(df.dropDuplicates(["id", "part"]), empty, ["id", "part"])).collect()
    assert _run(spark, source, folder, "c") == sorted(map(tuple, batch))


def test_two_streams_share_a_table(spark, folder):
    schema = "id long, part string, v int"
    for name, rows in (("a", [(1, "p", 9), (1, "p", 3), (2, "p", 4)]), ("b", [(3, "p", 5), (2, "p", 8)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
        found = _run(spark, f"{folder}/{name}", folder, f"checkpoint-{name}")
    assert found == [(1, "p", 6), (2, "p", 8), (3, "p", 10)]
    assert _run(spark, f"{folder}/a", folder, "checkpoint-c") == found
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/a")
    with pytest.raises(ValueError, match="already has the checkpoint"):
        ingest_stream(stream, f"{folder}/out", f"{folder}/other", _double, OUT, ["id", "part"], stream_id="checkpoint-a")


class _Threshold:
    """Stands for a model: says 1 for x above 5."""

    def transform(self, df):
        return df.withColumn("prediction", (F.col("x") > 5).cast("double")).withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))


def test_a_batch_run_again_is_counted_once(spark, folder):
    target, metrics = f"{folder}/scored", f"{folder}/metrics"
    say = [F.lit("m"), F.lit("e"), F.lit("t")]
    rows = spark.range(20).selectExpr("id", "CAST(id % 10 AS int) AS x", "CASE WHEN id >= 18 THEN NULL WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END AS `default`")
    first, second = (measured_batches(_Threshold(), ["x"], target, metrics, *say, name) for name in ("a", "b"))
    for batch_id, part in ((0, rows.filter("id < 10")), (1, rows.filter("id >= 10")), (1, rows.filter("id >= 10"))):
        first(part, batch_id)
    second(rows.filter("id < 4"), 0)
    second(rows.limit(0), 1)
    total = stream_metrics(spark, metrics).first()
    assert scan(spark, target).count() == 24 and total.tn + total.fp + total.fn + total.tp + total.unscored == 24
    by = {r.stream_id: r for r in stream_metrics(spark, metrics, ["stream_id"]).collect()}
    assert [by["a"][c] for c in ("tn", "fp", "fn", "tp", "unscored")] == [6, 3, 6, 3, 2]
    assert [by["b"][c] for c in ("tn", "fp", "fn", "tp", "unscored")] == [2, 0, 2, 0, 0] and by["b"].accuracy == 0.5


def test_stream_of_other_types_is_refused_before_it_starts(spark, folder):
    spark.range(3).selectExpr("id AS x").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("x long").parquet(f"{folder}/in")
    wanted = StructType([StructField("x", IntegerType())])
    say = [F.lit("m"), F.lit("e"), F.lit("t")]
    with pytest.raises(ValueError, match="x is bigint, not int"):
        score_stream_measured(stream, _Threshold(), ["x"], f"{folder}/o", f"{folder}/m", f"{folder}/c", *say, stream_id="s", signature=wanted)
    with pytest.raises(ValueError, match="x is bigint, not int"):
        score_stream(stream, _Threshold(), ["x"], f"{folder}/o", f"{folder}/c", *say, signature=wanted)
