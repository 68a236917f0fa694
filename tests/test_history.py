"""Increments to an indexed history: the same rows as a join with all of it, from few of its files."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loanline.operators.incremental import new_records
from loanline.plans import history
from loanline.plans.history import append_new, key_bitmaps, new_to_history, partitions_to_read, read_partitions

SCHEMA = "id long, start timestamp_ntz, v string"
BY = {"month": "date_format(start, 'yyyy-MM')"}
KEYS = ["id", "start"]


def rows_of(seed, n, months):
    rng = random.Random(seed)
    day = lambda: datetime(2020, rng.choice(months), 1) + timedelta(days=rng.randint(0, 25))
    return [(rng.choice([None, *range(60)]), rng.choice([None, day(), day(), day()]), f"{seed}-{i}") for i in range(n)]


def _files_opened(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


@pytest.mark.parametrize(("null_safe", "places"), [(True, 64), (False, 1 << 24)])
def test_as_a_join_with_everything(spark, folder, monkeypatch, null_safe, places):
    monkeypatch.setattr(history, "PLACES", places)  # few places: most partitions are read in vain
    known = []
    for seed, months in enumerate(([1, 2, 3], [3, 4], [1, 2, 3, 4, 9])):
        raw = spark.createDataFrame(rows_of(seed, 150, months), SCHEMA).repartition(3)
        want = new_records(raw, spark.createDataFrame(known, SCHEMA), KEYS, null_safe).collect()
        assert append_new(spark, raw, folder, KEYS, BY, null_safe) == len(want)
        known += want
        stored = spark.read.parquet(f"{folder}/rows").select("id", "start", "v").collect()
        assert sorted(map(str, stored)) == sorted(map(str, known))
    if null_safe:
        assert append_new(spark, raw, folder, KEYS, BY) == 0


def test_only_files_that_may_hold_a_key_are_read(spark, folder):
    rows = [(i, datetime(2000 + i // 100, 1, 1), "x") for i in range(3000)]  # thirty partitions
    append_new(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), folder, KEYS, BY)
    table, index = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/keys")
    raw = spark.createDataFrame([(205, datetime(2002, 1, 1), "again"), (2999, datetime(2029, 1, 1), "again"), (9, datetime(2031, 1, 1), "new")], SCHEMA)
    parts = partitions_to_read(index, raw, KEYS, ["month"])
    assert sorted(r.month for r in parts.collect()) == ["2002-01", "2029-01"]
    chosen = read_partitions(table, parts, ["month"])
    assert chosen.count() == 200 and _files_opened(chosen) * 10 < len(table.inputFiles()) == _files_opened(table)
    assert [r.v for r in new_to_history(spark, raw, folder, KEYS, BY).collect()] == ["new"]
    narrow = raw.withColumn("id", F.col("id").cast("int"))  # another type hashes otherwise, and is cast first
    assert [r.v for r in new_to_history(spark, narrow, folder, KEYS, BY).collect()] == ["new"]


def test_index_without_rows_loses_nothing(spark, folder):
    first = spark.createDataFrame([(1, datetime(2020, 1, 1), "a")], SCHEMA)
    append_new(spark, first, folder, KEYS, BY)
    second = spark.createDataFrame([(2, datetime(2020, 2, 1), "b")], SCHEMA)
    key_bitmaps(second.selectExpr("*", f"{BY['month']} AS month"), KEYS, ["month"]).write.mode("append").parquet(f"{folder}/keys")  # and then the job died
    assert append_new(spark, second, folder, KEYS, BY) == 1 and append_new(spark, second, folder, KEYS, BY) == 0
