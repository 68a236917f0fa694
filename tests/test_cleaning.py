from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loanline.functions import canonical_json, pick_all, pick_present, short_name
from loanline.operators.cleaning import (
    binary_label,
    fill_blanks,
    prepare,
    quarantined_rows,
    strict_label,
    strip_units,
    typed_records,
    valid_rows,
)
from loanline.operators.encoding import ordinal_code, ordinal_encode
from loanline.plans.preprocessing import run_steps
from loanline.schemas import LOAN_RECORD
from loanline.sources import project_features, require_columns

RECORD = dict(
    checking_balance="< 0 DM", months_loan_duration=6, credit_history="critical", purpose="car (new)", amount=1169,
    savings_balance="", employment_duration="> 7 yrs", percent_of_income=4, years_at_residence=4, age=67,
    other_credit="none", housing="own", existing_loans_count=2, job="skilled employee", dependents=1, phone="yes",
)


def _frame(spark, **changes):
    return spark.createDataFrame([tuple({**RECORD, **changes}.values())], LOAN_RECORD)


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("< 0 DM", "< 0"), (" 1 - 200DM  ", "1 - 200"), ("DM 5", "DM 5"), ("", ""), (None, None)],
)
def test_balance_units(spark, raw, clean):
    assert strip_units(_frame(spark, checking_balance=raw)).first().checking_balance == clean


@pytest.mark.parametrize(
    ("raw", "clean"), [("1 - 4 years", "1 - 4"), ("< 1 year", "< 1"), ("> 7 yrs", "> 7 yrs"), ("unemployed", "unemployed")]
)
def test_duration_units(spark, raw, clean):
    assert strip_units(_frame(spark, employment_duration=raw)).first().employment_duration == clean


def test_blank_becomes_unknown_but_null_stays(spark):
    row = fill_blanks(_frame(spark, savings_balance="", job=None)).first()
    assert (row.savings_balance, row.job, row.amount) == ("unknown", None, 1169)


def test_loose_label(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("maybe",), (None,)], "label string")
    assert [r[0] for r in df.select(binary_label("label")).collect()] == [1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("bad", ["maybe", None])
def test_strict_label_fails_on_other_values(spark, bad):
    df = spark.createDataFrame([("yes",), (bad,)], "label string")
    with pytest.raises(Exception, match="unmapped label"):
        df.select(strict_label("label")).collect()


@pytest.mark.parametrize(("percent", "months"), [(0, 6), (4, 0), (-1, 6), (None, 6)])
def test_income_is_null_without_positive_divisors(spark, percent, months):
    df = _frame(spark, percent_of_income=percent, months_loan_duration=months)
    assert prepare(df).first().monthly_income is None


def test_income(spark):
    assert prepare(_frame(spark)).first().monthly_income == 4870.83  # 1169 / 6 * 25


@pytest.mark.parametrize(("value", "code"), [("a", 0.0), ("unknown", 1.0), ("x", 2.0), (None, 2.0)])
def test_ordinal(spark, value, code):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(ordinal_code("v", ["a", "unknown"])).first()[0] == code


def test_ordinal_columns_keep_their_place(spark):
    assert ordinal_encode(_frame(spark)).columns == list(RECORD)


def test_step_switches(spark):
    row = run_steps(_frame(spark), {"unit_cleanup": False, "ordinal_encoding": False}).first()
    assert row.checking_balance == "< 0 DM" and row.monthly_income == 4870.83


def test_required_columns(spark):
    with pytest.raises(ValueError, match="the input lacks \\['income'\\]"):
        require_columns(_frame(spark), ["age", "income"])


def test_label_is_optional(spark):
    assert "label" not in project_features(_frame(spark)).columns


def test_quarantine(spark):
    texts = [{k: str(v) for k, v in RECORD.items()} for _ in range(3)]
    texts[1].update(amount="many", age=None)
    texts[2].update(purpose=None)
    schema = ", ".join(f"{k} string" for k in RECORD)
    typed = typed_records(spark.createDataFrame([tuple(t.values()) for t in texts], schema))
    assert dict(typed.dtypes)["amount"] == "int" and typed.columns == [*RECORD, "reason"]
    assert valid_rows(typed).count() == 1
    reasons = sorted(r.reason for r in quarantined_rows(typed).collect())
    assert reasons == ["amount: not int; age: missing", "purpose: missing"]


def test_short_names(spark):
    df = spark.createDataFrame([("xgboost",), ("gradient_boosting_classifier",), ("svm",), ("deep__net",)], "t string")
    assert [r[0] for r in df.select(short_name("t")).collect()] == ["XGB", "GBC", "SVM", "DN"]


def test_map_texts(spark):
    df = spark.createDataFrame([({"b": 1.0, "a": None},)], "m map<string,double>")
    row = df.select(
        canonical_json("m").alias("all"),
        canonical_json(pick_present("m", ["a", "c"])).alias("present"),
        canonical_json(pick_all("m", ["b", "c"])).alias("filled"),
        canonical_json(F.create_map().cast("map<string,double>")).alias("empty"),
    ).first()
    assert tuple(row) == ('{"a":null,"b":1.0}', '{"a":null}', '{"b":1.0,"c":null}', "{}")
