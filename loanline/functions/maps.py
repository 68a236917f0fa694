from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_json(column: Column | str) -> Column:
    """JSON text with sorted keys, so equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))), _KEEP_NULLS)


def pick_present(column: Column | str, keys: Sequence[str]) -> Column:
    """The listed keys that occur in the map."""
    return F.map_filter(column, lambda k, _: k.isin(*keys))


def pick_all(column: Column | str, keys: Sequence[str]) -> Column:
    """The listed keys, null where the map lacks one."""
    col = F.col(column) if isinstance(column, str) else column
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[col[k] for k in keys]))


def metric(column: Column | str, key: str) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return col[key]


def with_default(column: Column, value: float = 0.0) -> Column:
    return F.coalesce(column, F.lit(value))
