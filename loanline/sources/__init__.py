from loanline.sources.buckets import drop_replaced, read_buckets, replace_in_buckets
from loanline.sources.folders import cut_lineage, stored, work_folder
from loanline.sources.models import load_model, read_signature, save_model
from loanline.sources.tables import (
    append,
    counted,
    create_if_missing,
    overwrite,
    project_features,
    read_evolved,
    replace_keys,
    require_columns,
    scan,
)

__all__ = [
    "append",
    "counted",
    "create_if_missing",
    "cut_lineage",
    "drop_replaced",
    "load_model",
    "overwrite",
    "project_features",
    "read_buckets",
    "read_evolved",
    "read_signature",
    "replace_in_buckets",
    "replace_keys",
    "require_columns",
    "save_model",
    "scan",
    "stored",
    "work_folder",
]
