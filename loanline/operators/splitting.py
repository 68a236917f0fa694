"""Stratified split of exact size without a shuffle of the rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanline.operators.sizes import broadcast_if_small


def split_hash(key: str, seed: int) -> Column:
    """Order of the rows in the draw."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    fractions: Mapping[str, float] | None = None,
    seed: int = 42,
    digits: int = 4,
) -> DataFrame:
    """Add ``split``: per label, the first round(fraction * n) rows in hash order, part by part.

    Rows left over are "train". Rows without a label are a stratum of their own. Rows with the same key stay together, so the sizes are exact
    when keys are unique. Hashes are spread evenly over 16**digits prefixes, so the cut of a
    part lies in one small prefix: a count per prefix finds it, only the hashes of that prefix
    are put in order, and every row is then compared with the cut.
    """
    parts = dict(fractions or {"test": 0.2})
    drawn = df.select(F.struct(F.col(label).alias("label")).alias("stratum"), split_hash(key, seed).alias("place"))
    prefix = F.substring("place", 1, digits).alias("prefix")
    counts = drawn.groupBy("stratum", prefix).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("stratum").orderBy("prefix")
    whole = Window.partitionBy("stratum")
    counts = counts.withColumns({"last": F.sum("n").over(upto), "total": F.sum("n").over(whole)})

    shares, share = [], 0.0
    for name, fraction in parts.items():
        share += fraction
        last_row = F.floor(F.lit(share) * F.col("total") + 0.5).cast("bigint")
        shares.append(F.struct(F.lit(name).alias("part"), last_row.alias("row")))
    cuts = counts.select("stratum", "prefix", "last", "n", F.explode(F.array(*shares)).alias("cut"))
    cuts = cuts.filter((F.col("cut.row") > F.col("last") - F.col("n")) & (F.col("cut.row") <= F.col("last")))
    cuts = cuts.select("stratum", "prefix", "cut.part", (F.col("cut.row") - F.col("last") + F.col("n")).alias("nth"))

    cuts = broadcast_if_small(cuts)
    wanted = cuts.select("stratum", "prefix").distinct()
    near = drawn.withColumn("prefix", prefix).join(wanted, ["stratum", "prefix"], "left_semi")
    places = near.groupBy("stratum", "prefix", "place").agg(F.count(F.lit(1)).alias("rows"))
    within = Window.partitionBy("stratum", "prefix").orderBy("place")
    places = places.withColumn("upto", F.sum("rows").over(within))
    hit = (F.col("upto") >= F.col("nth")) & (F.col("upto") - F.col("rows") < F.col("nth"))
    limits = places.join(cuts, ["stratum", "prefix"]).filter(hit)
    limits = limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("part", "place"))).alias("cuts"))

    split = F.lit("train")
    for name in reversed(parts):
        split = F.when(F.col("split_place") <= F.col("cuts")[name], F.lit(name)).otherwise(split)
    placed = df.withColumn("split_place", split_hash(key, seed)).withColumn("split_stratum", F.struct(F.col(label).alias("label")))
    found = broadcast_if_small(limits.withColumnRenamed("stratum", "split_stratum"))
    joined = placed.join(found, "split_stratum", "left")
    return joined.withColumn("split", split).drop("split_place", "split_stratum", "cuts")
