"""A corpus for training, in five stages over ``documents``; each stage's rows are written and read back by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanline.llm import decontamination, lines, mixing, simhash, toxicity
from loanline.llm.text import table
from loanline.sources.folders import stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, scores as toxic go. Nulls and empty texts are scored too.

    Fitted on labelled rows outside fold 0 that are still in ``docs``; without any, all stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of over 50 words stay in one document only; a document that has no word left goes.

    ``n_chars`` is counted anew where lines were removed. A document that had no words before stays.
    """
    return lines.drop_repeats(docs, count="n_chars")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints, that with the smallest doc_id stays; wordless texts are one group."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in 20 lies in a benchmark window go; an empty benchmark takes none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What remains, mixed by source in shards; documents without words are in no mix."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Trained scores and 64-bit hashes of bytes have no counterpart in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
