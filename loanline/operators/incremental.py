"""Which rows are new."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanline.schemas import KEYS

_KEY = "record_key"


def _key(keys: Sequence[str], null_safe: bool) -> Column:
    """The key as one value: a struct compares its nulls as equal, a null struct matches nothing."""
    whole = F.struct(*keys)
    if null_safe:
        return whole
    return F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), whole)


def _known(existing: DataFrame, keys: Sequence[str], null_safe: bool) -> DataFrame:
    """Each key once. A key that many rows share is reduced before the shuffle, and the join
    has a shuffle of its own on both sides, which lets Spark split a hot key's rows."""
    return existing.select(*keys).distinct().select(_key(keys, null_safe).alias(_KEY))


def new_records(
    raw: DataFrame, existing: DataFrame, keys: Sequence[str] = tuple(KEYS), null_safe: bool = True
) -> DataFrame:
    """Rows of ``raw`` whose key is not in ``existing``; rows repeated in ``raw`` stay repeated.

    ``null_safe`` treats a null in the key as equal to null. Without it a row with a null in
    its key is new every time.
    """
    keyed = raw.withColumn(_KEY, _key(keys, null_safe))
    return keyed.join(_known(existing, keys, null_safe), _KEY, "left_anti").drop(_KEY)


def distinct_keys(df: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    return df.select(*keys).distinct()


def not_logged(df: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no log row yet; one set-wise join in place of a probe per row."""
    return new_records(df, log, keys, null_safe=False)


def with_logged_flag(df: DataFrame, log: DataFrame, keys: Sequence[str], flag: str = "already_logged") -> DataFrame:
    """All rows, with whether a log row with the same key exists."""
    known = _known(log, keys, False).withColumn(flag, F.lit(True))
    flagged = df.withColumn(_KEY, _key(keys, False)).join(known, _KEY, "left").drop(_KEY)
    return flagged.withColumn(flag, F.coalesce(flag, F.lit(False)))
