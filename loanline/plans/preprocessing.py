"""Raw loans to feature vectors: full load, increment, and the step list."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType

from loanline.operators.cleaning import prepare, unit_cleanup
from loanline.operators.encoding import (
    MAX_CATEGORIES,
    fit_one_hot,
    fit_scaler,
    numeric_columns,
    one_hot,
    ordinal_encode,
    scale,
    summarise,
)
from loanline.operators.incremental import new_records
from loanline.schemas import KEYS, NOMINAL
from loanline.sources.models import load_model, read_note, save_model, save_note
from loanline.sources.tables import append, exists, overwrite, project_features, scan

# Row-wise steps in order; the last two steps of a load need a fit and are in Preprocessor.
ROW_STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "unit_cleanup": unit_cleanup,
    "data_preparation": prepare,
    "ordinal_encoding": ordinal_encode,
}


def run_steps(df: DataFrame, enabled: Mapping[str, bool] | None = None) -> DataFrame:
    """Apply the row-wise steps that are switched on, in order; all of them by default."""
    for name, step in ROW_STEPS.items():
        if (enabled or {}).get(name, True):
            df = df.transform(step)
    return df


@dataclass
class Preprocessor:
    """Fitted one-hot and scaling models, and the steps that are switched off.

    Text columns that no step encodes stay out of the vector and are kept beside it. Without "scaling" there is no
    vector, the encoded columns stay.
    """

    nominal: PipelineModel | None
    scaler: PipelineModel | None
    enabled: Mapping[str, bool] = field(default_factory=dict)

    @staticmethod
    def fit(
        raw: DataFrame,
        invalid: str = "error",
        impute: str | None = None,
        enabled: Mapping[str, bool] | None = None,
        max_categories: int = MAX_CATEGORIES,
    ) -> Preprocessor:
        """Fit on projected raw rows; a nominal column may have ``max_categories`` values.

        Two passes: one for the categories and the fills, one for the moments. The cleaned rows are not kept: each
        pass reads only the columns it needs, and cleaning costs less than storing a large table again.
        """
        steps = dict(enabled or {})
        with_nominal, with_scaler = steps.get("one_hot", True), steps.get("scaling", True)
        cleaned = run_steps(raw, steps)
        inputs = [c for c in cleaned.columns if c not in (*KEYS, "label")]
        gaps = numeric_columns(cleaned, inputs) if impute and with_scaler else ()
        texts = NOMINAL if with_nominal else ()
        known = summarise(cleaned, texts, gaps, impute, max_categories) if texts or gaps else None
        nominal = fit_one_hot(cleaned, known=known) if with_nominal else None
        coded = one_hot(cleaned, nominal) if nominal else cleaned
        scaler = None
        if with_scaler:
            exclude = (*KEYS, "label", *_texts(coded))
            scaler = fit_scaler(coded, exclude, invalid=invalid, impute=impute, known=known)
        return Preprocessor(nominal, scaler, steps)

    def apply(self, raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """Keys, feature vector and label; one projection, no shuffle."""
        rows = run_steps(raw, self.enabled)
        rows = one_hot(rows, self.nominal) if self.nominal else rows
        if self.scaler is None:
            return rows.select(*keys, *[c for c in rows.columns if c not in KEYS])
        return scale(rows, self.scaler, [*keys, *[c for c in _texts(rows) if c not in keys]])

    def save(self, path: str) -> None:
        for name, model in (("nominal", self.nominal), ("scaler", self.scaler)):
            if model:
                save_model(model, f"{path}/{name}")
        save_note(SparkSession.active(), dict(self.enabled), f"{path}/switches")

    @staticmethod
    def load(path: str) -> Preprocessor:
        steps = read_note(SparkSession.active(), f"{path}/switches")
        nominal = load_model(f"{path}/nominal") if steps.get("one_hot", True) else None
        return Preprocessor(nominal, load_model(f"{path}/scaler") if steps.get("scaling", True) else None, steps)


def _texts(df: DataFrame) -> list[str]:
    """Text columns other than keys and label."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return [c for c in texts if c not in (*KEYS, "label")]


def full_load(raw: DataFrame, target: str, model_path: str, keys: Sequence[str] = (), **fit: Any) -> int:
    """Fit, rewrite the feature table, save the models; returns the rows written."""
    rows = project_features(raw, keys=keys)
    fitted = Preprocessor.fit(rows, **fit)
    written = overwrite(fitted.apply(rows, keys), target)
    fitted.save(model_path)
    return written


def incremental_load(
    spark: SparkSession,
    raw: DataFrame,
    target: str,
    model_path: str,
    keys: Sequence[str] = tuple(KEYS),
    null_safe: bool = True,
    **fit: Any,
) -> int:
    """Append the loans not yet in the feature table, coded by the models saved by the full load.

    Using the stored models keeps all rows of the table on one scale and width. Without a table this is the full load.
    """
    if not exists(spark, target):
        return full_load(raw, target, model_path, keys, **fit)
    fresh = new_records(project_features(raw, keys=keys), scan(spark, target), keys, null_safe)
    return append(Preprocessor.load(model_path).apply(fresh, keys), target)
