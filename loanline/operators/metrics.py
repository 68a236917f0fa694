"""Binary-classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanline.functions.numbers import ratio


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * n_class) of each class."""
    counts = label_counts(df, label)
    everything = Window.partitionBy(F.lit(0))  # one row per class
    return counts.withColumn(
        "weight", F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    )


def confusion_cells(truth: Column, predicted: Column, unscored: bool = False) -> list[Column]:
    """tn, fp, fn, tp as aggregates; with ``unscored`` also the rows in none of them, for a null or another value."""

    def cell(actual: int, guess: int) -> Column:
        return F.count_if((truth == actual) & (predicted == guess))

    cells = {"tn": cell(0, 0), "fp": cell(0, 1), "fn": cell(1, 0), "tp": cell(1, 1)}
    if unscored:
        cells["unscored"] = F.count_if(~F.coalesce(truth.isin(0, 1) & predicted.isin(0, 1), F.lit(False)))
    return [c.alias(name) for name, c in cells.items()]


def confusion(
    df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), unscored: bool = False
) -> DataFrame:
    """tn, fp, fn, tp in one pass."""
    return df.groupBy(*by).agg(*confusion_cells(F.col(truth), F.col(predicted), unscored))


def binary_metrics(
    df: DataFrame, truth: str, predicted: str, by: Sequence[str] = (), unscored: bool = False
) -> DataFrame:
    """Confusion cells with accuracy, precision, recall and F1 (0 where undefined).

    ``hard_auc`` is the ROC-AUC of the predicted labels, null when a class is absent. Rows in no cell are in no
    metric; ``unscored`` adds their number.
    """
    tail = ["unscored"] if unscored else []
    return ratios(confusion(df, truth, predicted, by, unscored), [*by], tail)


def ratios(cells: DataFrame, by: Sequence[str] = (), tail: Sequence[str] = ()) -> DataFrame:
    """The metrics beside their cells."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    recall = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    specificity = F.try_divide(tn.cast("double"), (tn + fp).cast("double"))
    return cells.select(
        *by,
        *["tn", "fp", "fn", "tp"],
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / 2).alias("hard_auc"),
        *tail,
    )


def confusion_json() -> Column:
    """[[tn, fp], [fn, tp]] as text."""
    return F.to_json(F.array(F.array("tn", "fp"), F.array("fn", "tp")))


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC with ties counted half, null when a class is absent.

    Rows are first counted per score, so a score many rows share is one row. The distinct
    scores are range-partitioned; the running count of negatives is taken inside a range
    and only the range totals are ordered as a whole.
    """
    keys = list(by)
    one = F.col(truth) == 1
    scored = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
    counts = scored.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(one).alias("pos"), F.count_if(~one).alias("neg")
    )
    sliced = counts.repartitionByRange(*keys, "score").withColumn("slice", F.spark_partition_id())

    inside = Window.partitionBy(*keys, "slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    wins = F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2)
    per_slice = sliced.withColumn("below", below).groupBy(*keys, "slice").agg(
        F.sum(wins).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )

    ordered = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.withColumn("before", F.coalesce(F.sum("neg").over(ordered), F.lit(0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    total = F.sum(F.col("wins") + F.col("pos").cast("double") * F.col("before"))
    return before.groupBy(*keys).agg(F.try_divide(total, pairs).alias("roc_auc"))
