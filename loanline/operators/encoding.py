"""Ordinal codes, one-hot vectors and standardised feature vectors."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from loanline.operators.ordering import number_in_order
from loanline.schemas import KEYS, NOMINAL, ORDINAL_CATEGORIES

MAX_CATEGORIES = 10_000
NULL_CATEGORY, BLANK_CATEGORY = "(null)", "(blank)"


def ordinal_code(column: Column | str, categories: Sequence[str]) -> Column:
    """Place in the list; a value outside it, null included, gets the length of the list."""
    col = F.col(column) if isinstance(column, str) else column
    places = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, float(i))])
    return F.coalesce(F.try_element_at(places, col), F.lit(float(len(categories))))


def ordinal_encode(df: DataFrame, categories: Mapping[str, Sequence[str]] = ORDINAL_CATEGORIES) -> DataFrame:
    return df.withColumns({c: ordinal_code(c, listed) for c, listed in categories.items()})


@dataclass
class Summary:
    """What the fits need to know of the data: rows, values by frequency (ties in text order), fills of gaps."""

    rows: int
    values: dict[str, list[str]]
    fills: dict[str, float]


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, NumericType)]


def summarise(
    df: DataFrame,
    texts: Sequence[str],
    numbers: Sequence[str] = (),
    impute: str | None = None,
    max_categories: int = MAX_CATEGORIES,
) -> Summary:
    """One scan for the values of all text columns and the mean or median of the numeric ones.

    Each grouping set is one column's values, the last one the whole table. Nulls and NaN do not count. Fails when a
    column has more than ``max_categories`` distinct values; no more than that many a column reach the driver.
    """
    one = F.count(F.lit(1)).alias("rows")
    known = {c: F.when(~F.isnan(c), F.col(c).cast("double")) for c in numbers}
    middle = {None: F.avg, "mean": F.avg, "median": lambda c: F.percentile_approx(c, 0.5)}[impute]
    fills = [middle(c).alias(f"fill {name}") for name, c in known.items()]
    keys = [F.col(c) for c in texts]
    marks = [F.grouping(c).alias(f"all {c}") for c in texts]
    sets = df.groupingSets([*[[k] for k in keys], []], *keys).agg(one, *marks, *fills) if texts else df.agg(one, *fills)

    bound = len(texts) * (max_categories + 1) + 1
    found = sets.limit(bound + 1).collect()
    total, counts = None, {c: [] for c in texts}
    for row in found:
        column = next((c for c in texts if row[f"all {c}"] == 0), None)
        if column is None:
            total = row
        elif row[column] is not None:
            counts[column].append((-row["rows"], str(row[column])))
    over = [c for c, listed in counts.items() if len(listed) > max_categories]
    if over or len(found) > bound:
        raise ValueError(f"too many distinct values to index (limit {max_categories}): {over or list(texts)}")
    values = {c: [v for _, v in sorted(listed)] for c, listed in counts.items()}
    if total is None:  # an empty table has no grand total
        return Summary(0, values, dict.fromkeys(numbers))
    return Summary(total["rows"], values, {c: total[f"fill {c}"] for c in numbers})


def _indexers(values: Mapping[str, list[str]], outputs: Mapping[str, str]) -> list[StringIndexerModel]:
    """One model a column: a shared one would fill up shorter lists with nulls."""
    return [StringIndexerModel.from_labels(values[c], c, out, handleInvalid="keep") for c, out in outputs.items()]


def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value, n, index): most frequent value first, ties in text order.

    All columns are counted in one aggregation; the distinct values are numbered range by range, so a column may have
    any number of them.
    """
    long = df.select(*columns).unpivot([], list(columns), "column", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    turns = counts.withColumn("turn", F.struct((-F.col("n")).alias("rarer"), "value"))
    numbered = number_in_order(turns, "column", "turn", "index")
    return numbered.select("column", "value", "n", (F.col("index") - 1).cast("int").alias("index"))


def fit_one_hot(
    df: DataFrame,
    columns: Sequence[str] = tuple(NOMINAL),
    max_categories: int = MAX_CATEGORIES,
    known: Summary | None = None,
) -> PipelineModel:
    """Index all columns in one pass over the data, or none where it is ``known``, then one-hot them.

    A value not seen in the fit, null included, becomes the zero vector.
    """
    known = known or summarise(df, columns, max_categories=max_categories)
    places = {c: f"{c}_index" for c in columns}
    encode = OneHotEncoder(inputCols=list(places.values()), outputCols=[f"{c}_vec" for c in columns], dropLast=True)
    return Pipeline(stages=[*_indexers(known.values, places), encode]).fit(df.select(*columns))


def one_hot(df: DataFrame, model: PipelineModel, columns: Sequence[str] = tuple(NOMINAL)) -> DataFrame:
    """Replace the text columns by their vectors."""
    return model.transform(df).drop(*columns, *[f"{c}_index" for c in columns])


def fit_scaler(
    df: DataFrame,
    exclude: Sequence[str] = (*KEYS, "label"),
    invalid: str = "error",
    impute: str | None = None,
    known: Summary | None = None,
) -> PipelineModel:
    """Assemble all but the excluded columns and standardise them (sample deviation).

    ``invalid`` says what a null does: "error" fails, "skip" leaves the row out.
    ``impute`` ("mean" or "median") fills nulls and NaN of numeric columns first, with what is ``known`` or one more
    pass finds.
    """
    inputs = [c for c in df.columns if c not in exclude]
    stages = []
    if impute:
        gaps = numeric_columns(df, inputs)
        known = known or summarise(df, [], gaps, impute)
        empty = [c for c in gaps if known.fills[c] is None]
        if empty:
            raise ValueError(f"no value to fill {empty} with")
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        filled = ", ".join(
            f"CAST(CASE WHEN `{c}` IS NULL OR isnan(`{c}`) THEN {known.fills[c]!r}D ELSE `{c}` END AS {kinds[c]}) "
            f"AS `{c}_filled`"
            for c in gaps
        )
        stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
        inputs = [f"{c}_filled" if c in gaps else c for c in inputs]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="unscaled_features", handleInvalid=invalid))
    stages.append(StandardScaler(inputCol="unscaled_features", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=stages).fit(df)


def scale(df: DataFrame, model: PipelineModel, keep: Sequence[str] = ()) -> DataFrame:
    """Keys, feature vector and label; the vector keeps the names of its slots."""
    tail = ["label"] if "label" in df.columns else []
    done = model.transform(df)
    slots = [{"idx": i, "name": n} for i, n in enumerate(slot_names(done, "unscaled_features"))]
    named = {"ml_attr": {"attrs": {"numeric": slots}, "num_attrs": len(slots)}}
    return done.select(*keep, F.col("features").alias("features", metadata=named), *tail)


def slot_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of the vector's slots, in order, from its column metadata."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"]
    slots = sorted((a for group in groups.values() for a in group), key=lambda a: a["idx"])
    return [a["name"] for a in slots]


def fit_training_features(
    df: DataFrame,
    features: Sequence[str],
    invalid: str = "error",
    max_categories: int = MAX_CATEGORIES,
) -> PipelineModel:
    """One-hot every string column and standardise every numeric one, split by column type.

    Null and the empty text are categories of their own; unseen values become zeros. The deviation here is the
    population one, hence the factor after the scaler.
    """
    kinds = {f.name: f.dataType for f in df.select(*features).schema.fields}
    texts = [c for c in features if isinstance(kinds[c], StringType)]
    numbers = [c for c in features if c not in texts]
    filled = ", ".join(
        f"CASE WHEN `{c}` IS NULL THEN '{NULL_CATEGORY}' WHEN `{c}` = '' THEN '{BLANK_CATEGORY}' ELSE `{c}` END "
        f"AS `{c}_text`"
        for c in texts
    )
    fill = [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")] if texts else []
    known = summarise(fill[0].transform(df) if fill else df, [f"{c}_text" for c in texts], max_categories=max_categories)
    rows = known.rows
    places = {f"{c}_text": f"{c}_index" for c in texts}
    encode = OneHotEncoder(inputCols=list(places.values()), outputCols=[f"{c}_vec" for c in texts], dropLast=True)
    gather = VectorAssembler(inputCols=numbers, outputCol="numbers", handleInvalid=invalid)
    shrink = math.sqrt(rows / (rows - 1)) if rows > 1 else 1.0
    spread = StandardScaler(inputCol="numbers", outputCol="numbers_sample", withMean=True, withStd=True)
    factor = ElementwiseProduct(
        inputCol="numbers_sample", outputCol="numbers_scaled", scalingVec=Vectors.dense([shrink] * len(numbers))
    )
    join = VectorAssembler(inputCols=[*encode.getOutputCols(), "numbers_scaled"], outputCol="features")
    stages = [*fill, *_indexers(known.values, places), encode] if texts else []
    return Pipeline(stages=[*stages, gather, spread, factor, join]).fit(df)
