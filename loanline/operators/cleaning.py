"""Unit clean-up, label coding and derived columns: one projection each, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loanline.functions.numbers import scaled_ratio
from loanline.functions.text import UNIT_SUFFIXES, strip_suffix
from loanline.schemas import LOAN_RECORD


def strip_units(df: DataFrame, suffixes: Mapping[str, str] = UNIT_SUFFIXES) -> DataFrame:
    return df.withColumns({c: strip_suffix(c, pattern) for c, pattern in suffixes.items()})


def fill_blanks(df: DataFrame, fill: str = "unknown") -> DataFrame:
    """Empty strings of every string column become ``fill``; nulls stay null."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.replace("", fill, subset=texts)


def unit_cleanup(df: DataFrame) -> DataFrame:
    return fill_blanks(strip_units(df))


def binary_label(column: Column | str, positive: str = "yes") -> Column:
    """1.0 for the positive word, 0.0 for anything else, null included."""
    col = F.col(column) if isinstance(column, str) else column
    return F.when(col == positive, 1.0).otherwise(0.0)


def strict_label(column: Column | str) -> Column:
    """yes/no to 1/0; any other value fails the job."""
    col = F.col(column) if isinstance(column, str) else column
    unmapped = F.raise_error(F.concat(F.lit("unmapped label: "), F.coalesce(col, F.lit("NULL")))).cast("int")
    return F.when(col == "yes", 1).when(col == "no", 0).otherwise(unmapped)


def prepare(df: DataFrame) -> DataFrame:
    """Code the label and derive ``monthly_income``."""
    income = scaled_ratio(F.col("amount"), F.col("months_loan_duration"), F.col("percent_of_income"))
    coded = {"label": binary_label("label")} if "label" in df.columns else {}
    return df.withColumns({**coded, "monthly_income": income})


def typed_records(df: DataFrame, record: StructType = LOAN_RECORD) -> DataFrame:
    """Cast each field of a text record to its type and say in ``reason`` what failed.

    ``reason`` is null for a valid row. Every field is required.
    """
    texts = [f for f in record.fields if isinstance(f.dataType, StringType)]
    others = [f for f in record.fields if f not in texts]
    typed = df.withColumns({f"typed_{f.name}": F.col(f.name).try_cast(f.dataType) for f in others})

    def problem(field: StructField) -> Column:
        missing = F.lit(f"{field.name}: missing")
        if field in texts:
            return F.when(F.col(field.name).isNull(), missing)
        wrong = F.lit(f"{field.name}: not {field.dataType.simpleString()}")
        return F.when(F.col(f"typed_{field.name}").isNull(), F.when(F.col(field.name).isNull(), missing).otherwise(wrong))

    found = typed.withColumn("reason", F.nullif(F.concat_ws("; ", *map(problem, record.fields)), F.lit("")))
    replaced = found.withColumns({f.name: F.col(f"typed_{f.name}") for f in others})
    return replaced.drop(*[f"typed_{f.name}" for f in others])


def valid_rows(typed: DataFrame) -> DataFrame:
    return typed.filter(F.col("reason").isNull()).drop("reason")


def quarantined_rows(typed: DataFrame) -> DataFrame:
    return typed.filter(F.col("reason").isNotNull())
