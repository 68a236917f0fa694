"""Column expressions: Column in, Column out."""

from loanline.functions.maps import canonical_json, metric, pick_all, pick_present, with_default
from loanline.functions.naming import (
    endpoint_name,
    experiment_name,
    model_name,
    run_name,
    short_name,
)
from loanline.functions.numbers import ratio, scaled_ratio
from loanline.functions.text import strip_suffix

__all__ = [
    "canonical_json",
    "endpoint_name",
    "experiment_name",
    "metric",
    "model_name",
    "pick_all",
    "pick_present",
    "ratio",
    "run_name",
    "scaled_ratio",
    "short_name",
    "strip_suffix",
    "with_default",
]
