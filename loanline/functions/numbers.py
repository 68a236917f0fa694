from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def scaled_ratio(amount: Column, months: Column, percent: Column) -> Column:
    """Monthly amount scaled up to the whole income; null unless both divisors are positive."""
    guard = (percent > 0) & (months > 0)
    return F.round(F.when(guard, (amount / months) * (F.lit(100) / percent)), 2)
