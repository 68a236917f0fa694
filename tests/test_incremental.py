from __future__ import annotations

from datetime import datetime

import pytest

from loanline.operators.incremental import distinct_keys, new_records, with_logged_flag
from loanline.schemas import KEYS

SCHEMA = "id bigint, start_date timestamp_ntz, end_date timestamp_ntz"
A, B = datetime(2020, 1, 1), datetime(2021, 1, 1)
RAW = [(1, A, B), (1, A, None), (2, A, B), (2, A, B), (None, A, B), (3, B, None)]
STORED = [(1, A, B), (1, A, B), (1, A, None), (None, A, B)]


def _ids(df):
    return sorted(str(tuple(r)) for r in df.collect())


def _brute(null_safe):
    def known(row):
        return row in STORED and (null_safe or None not in row)

    return sorted(str(r) for r in RAW if not known(r))


@pytest.mark.parametrize("null_safe", [True, False])
def test_new_records(spark, null_safe):
    raw, stored = spark.createDataFrame(RAW, SCHEMA), spark.createDataFrame(STORED, SCHEMA)
    assert _ids(new_records(raw, stored, null_safe=null_safe)) == _brute(null_safe)


def test_nothing_is_new_twice(spark):
    raw = spark.createDataFrame(RAW, SCHEMA)
    assert new_records(raw, raw).count() == 0


def test_empty_table_means_full_load(spark):
    raw = spark.createDataFrame(RAW, SCHEMA)
    assert new_records(raw, spark.createDataFrame([], SCHEMA)).count() == len(RAW)


def test_one_key_on_a_third_of_the_rows(spark):
    raw = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 0, id) AS id", "timestamp_ntz'2020-01-01' AS start_date", "CAST(NULL AS timestamp_ntz) AS end_date"
    )
    stored = raw.filter("id = 0 OR id > 1500")
    assert new_records(raw, stored).count() == raw.filter("id <> 0 AND id <= 1500").count()


def test_distinct_keys_treat_nulls_as_equal(spark):
    assert distinct_keys(spark.createDataFrame(STORED, SCHEMA), KEYS).count() == 3


def test_flag_keeps_all_rows(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    log = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    found = with_logged_flag(left, log, ["k"]).collect()
    assert sorted((r.k or "", r.already_logged) for r in found) == [("", False), ("a", True), ("a", True), ("b", False)]
