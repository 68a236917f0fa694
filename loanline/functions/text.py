from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: unit suffixes at the end of the raw text columns ----
UNIT_SUFFIXES = {
    "checking_balance": r"\s*DM\s*$",
    "savings_balance": r"\s*DM\s*$",
    "employment_duration": r"\s*years?\s*$",
}


def strip_suffix(column: Column | str, pattern: str) -> Column:
    """Remove a trailing unit and the blanks around the rest."""
    return F.trim(F.regexp_replace(column, pattern, ""))
