"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's rows are dealt by a hash into permuted blocks; its target in words is a number of whole passes over the
blocks and a first part of one more pass. The block quotas of all sources are split among the output shards by a binary
tree: every node gives its left half an exact share, drawn without replacement. A shard then takes its quota of each
source's permuted blocks, which no other shard has, and orders their rows by a hash of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanline.llm.text import split_words, word_count
from loanline.sources.folders import stored

SEED = "mix"
#: Hexadecimal digits of the row key that name a block: 4,096 blocks for each source and pass.
BLOCK_DIGITS = 3
#: Sources up to which their plan is made on the driver and broadcast; that of more is made in tables.
MAX_SOURCES = 10_000
#: Bundles of sources whose quotas the tree splits where sources are more than that.
BUNDLES = 4096
#: Block draws up to which their table is broadcast; a larger one is joined by a shuffle.
BROADCAST_DRAWS = 200_000
#: Words of an output shard, and the most shards.
SHARD_WORDS = 1 << 22
MAX_SHARDS = 4096


def targets(sizes: list[int], weights: list[float], share: float, ceiling: float) -> list[float]:
    """Shares of ``share`` * total by weight, none above ``ceiling`` times its size; what is over goes to the others by weight.

    With too little room for all of it every source gets its ceiling.
    """
    order = sorted(range(len(sizes)), key=lambda i: ceiling * sizes[i] / weights[i])
    left, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    for place, i in enumerate(order):
        top = ceiling * sizes[i]
        if top / weights[i] > left / weight:
            for j in order[place:]:
                out[j] = left / weight * weights[j]
            break
        out[i] = top
        left, weight = left - top, weight - weights[i]
    return out


def _running(rows: DataFrame, order: Sequence[Column], **values: Column) -> DataFrame:
    """``rows`` with the sum of each value over all rows before, in an ``order`` without ties.

    Rows are dealt in ranges; sums run inside a range, and only the totals of the ranges are put in one order.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()), "mix-ranges")
    inside = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    between = Window.partitionBy(F.lit(0)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__slice").agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    before = totals.select("__slice", *[F.coalesce(F.sum(f"__{n}").over(between), F.lit(0)).alias(f"__{n}") for n in values])
    sums = [(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"__{n}")).alias(n) for n, v in values.items()]
    return ranged.join(before, "__slice").select(*rows.columns, *sums)


def _targets_table(sums: DataFrame, weigh, share: float, ceiling: float) -> DataFrame:
    """(__source, source_size, target) by the rule of ``targets``, for any number of (__source, size)."""
    order = [F.col("__source") == "n", F.col("__source")]
    if hasattr(weigh, "by_place"):
        weighed = _running(sums, order, place=F.lit(1)).withColumn("weight", weigh.by_place(F.col("place")))
    else:  # a function of the list of all names needs that list
        keys = [row[0] for row in sums.select("__source").orderBy(*order).toLocalIterator()]
        weights = [float(w) for w in weigh([None if k == "n" else k[1:] for k in keys])]
        listed = sums.sparkSession.createDataFrame(list(zip(keys, weights, strict=True)), "__source string, weight double")
        weighed = sums.join(listed, "__source")
    top = F.lit(float(ceiling)) * F.col("size")
    weighed = stored(weighed.select("__source", "size", "weight", top.alias("top"), (top / F.col("weight")).alias("ratio")), "mix-weights")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    filled = _running(weighed, [F.col("ratio"), F.col("__source")], below=F.col("top"), used=F.col("weight"))
    level = (F.lit(float(share * total["size"])) - F.col("below")) / (F.lit(float(total["weight"])) - F.col("used"))
    over = filled.withColumn("level", level).filter("ratio > level")
    first = over.agg(F.min(F.struct("ratio", (-F.col("level")).alias("level"))).alias("first")).first()["first"]
    target = F.col("top")
    if first is not None:
        level = F.lit(-first["level"])
        target = F.when(F.col("ratio") <= level, F.col("top")).otherwise(level * F.col("weight"))
    return weighed.select("__source", F.col("size").alias("source_size"), target.alias("target"))


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))


def _row_name(doc_id: str, text: str) -> Column:
    """Equal only for rows with the same id and text."""
    return F.concat_ws(":", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def _key(pass_: Column) -> Column:
    """The place of a row in a pass over its source."""
    return F.md5(F.concat_ws(":", F.lit(SEED), pass_.cast("string"), F.col("__row")))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(n, doc_id, __source, __row, __size), stored; ``n`` numbers the rows."""
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("n"),
            F.col(f"`{doc_id}`").alias("doc_id"),
            _source_key(source).alias("__source"),
            _row_name(doc_id, text).alias("__row"),
            word_count(F.col(f"`{text}`")).alias("__size"),
        ),
        "sized",
    )


@dataclass
class Plan:
    """sources: a row for each (__source, source_size, target, passes, cut, part). draws: (__source, pass, block, shard).

    ``few``: the table of sources is small enough to be broadcast.
    """

    sources: DataFrame
    draws: DataFrame
    n_draws: int
    shards: int
    few: bool = True


def _hinted(table: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(table) if few else table


def _cuts(rows: DataFrame, rests: DataFrame, few: bool = True) -> DataFrame:
    """(__source, cut, part): the row key at which the last, partial pass of a source ends.

    Rows below ``cut`` are taken whole, those at it (equal rows) with ``part`` words each. The cut is found from sums by
    block, then by the parts of that one block, then by its rows, so no step orders more than one small block.
    """
    keyed = rows.filter("__size > 0").join(_hinted(rests, few), "__source").withColumn("key", _key(F.col("passes")))
    keyed = keyed.select("__source", "key", "__size", "rest")
    found = rests.select("__source", F.lit("").alias("prefix"), F.col("rest").alias("need"))
    for digits in (BLOCK_DIGITS, 2 * BLOCK_DIGITS, 32):
        inside = keyed.join(_hinted(found, few), "__source").filter(F.expr("startswith(key, prefix)"))
        sums = inside.groupBy("__source", F.substring("key", 1, digits).alias("prefix")).agg(
            F.sum("__size").alias("words"), F.count("*").alias("rows"), F.first("need").alias("need")
        )
        before = F.sum("words").over(Window.partitionBy("__source").orderBy("prefix")) - F.col("words")
        found = (
            sums.withColumn("before", before)
            .filter("before <= need and need < before + words")
            .select("__source", "prefix", (F.col("need") - F.col("before")).alias("need"), "rows")
        )
        found = stored(found, "mix-cut")
    return found.select("__source", F.col("prefix").alias("cut"), F.floor(F.col("need") / F.col("rows")).alias("part"))


def _leaves(shards: int, quotas: np.ndarray, names: list[str]):
    """Each shard walks down the tree; nodes draw from a generator of their own, so all shards see the same splits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["shard"] if names else []:
                low, high, own = 0, shards, quotas
                while high - low > 1:
                    middle = (low + high) // 2
                    draw = np.random.Generator(np.random.Philox(key=[low, high]))
                    total = int(own.sum())
                    left = draw.multivariate_hypergeometric(own, total * (middle - low) // (high - low), method="marginals")
                    low, high, own = (low, middle, left) if shard < middle else (middle, high, own - left)
                yield pd.DataFrame({"__source": names, "shard": int(shard), "quota": own})

    return run


def _copies(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``rows`` once for each pass that takes words of them, with pass, words, block and __key."""
    return (
        rows.filter("__size > 0")
        .join(_hinted(sources.select("__source", "passes", "cut", "part"), few), "__source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
        .withColumn("__key", _key(F.col("pass")))
        .withColumn(
            "words",
            F.when((F.col("pass") < F.col("passes")) | (F.col("__key") < F.col("cut")), F.col("__size")).when(
                F.col("__key") == F.col("cut"), F.least("__size", F.col("part"))
            ),
        )
        .filter("words > 0")
        .withColumn("block", F.substring("__key", 1, BLOCK_DIGITS))
        .drop("passes", "cut", "part")
    )


def _all_blocks(sources: DataFrame) -> DataFrame:
    """(__source, pass, block) of every block of every pass, with rows or without."""
    last = F.when(F.col("cut").isNull(), 0).otherwise(F.conv(F.substring("cut", 1, BLOCK_DIGITS), 16, 10).cast("long") + 1)
    draws = sources.select("__source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"), "passes", last.alias("last"))
    size = F.when(F.col("pass") < F.col("passes"), F.lit(16**BLOCK_DIGITS)).otherwise(F.col("last"))
    draws = draws.withColumn("size", size).filter("size > 0")
    draws = draws.select("__source", "pass", F.explode(F.expr("sequence(0L, size - 1)")).alias("number"))
    return draws.select("__source", "pass", F.lower(F.lpad(F.hex("number"), BLOCK_DIGITS, "0")).alias("block"))


def plan_mix(
    rows: DataFrame, weigh, share: float = 1.5, ceiling: float = 2.0, shard_words: int = SHARD_WORDS, max_sources: int = MAX_SOURCES
) -> Plan:
    """The plan of a mix of ``sized`` rows; ``weigh`` gives the weights of a sorted list of source names (null last).

    With more than ``max_sources`` sources the plan is made in tables: targets by running sums, blocks only where rows
    are, and the tree splits the quotas of bundles of sources, whose blocks are permuted as those of one source. ``weigh``
    gets the list of all names then too, unless it has ``by_place``, the weight as a column of the place in that list.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("size"))
    sums = sizes.limit(max_sources + 1).collect()
    few = len(sums) <= max_sources
    if few:
        sums = sorted(sums, key=lambda r: (r["__source"] == "n", r["__source"]))
        held = [int(r["size"]) for r in sums]
        weights = weigh([None if r["__source"] == "n" else r["__source"][1:] for r in sums]) if sums else []
        wanted = targets(held, weights, share, ceiling)
        whole = [int(np.floor(t + 0.5)) for t in wanted]
        listed = [
            (r["__source"], size, target, words // size if size else 0, words % size if size else 0)
            for r, size, target, words in zip(sums, held, wanted, whole, strict=True)
        ]
        sources = spark.createDataFrame(listed, "__source string, source_size long, target double, passes long, rest long")
        words = sum(whole)
    else:
        wanted = _targets_table(stored(sizes, "mix-sizes"), weigh, share, ceiling)
        wanted = wanted.withColumn("whole", F.floor(F.col("target") + 0.5).cast("long"))
        passes, rest = (F.expr(f"if(source_size > 0, whole {op} source_size, 0L)") for op in ("div", "%"))
        sources = stored(wanted.withColumn("passes", passes).withColumn("rest", rest), "mix-targets")
        words = int(sources.agg(F.sum("whole")).first()[0])
        sources = sources.drop("whole")
    cuts = _cuts(rows, sources.filter("rest > 0").select("__source", "passes", "rest"), few)
    sources = stored(sources.join(cuts, "__source", "left"), "mix-sources")

    if few:
        draws = _all_blocks(sources).withColumn("colour", F.col("__source"))
    else:
        bundle = F.pmod(F.xxhash64("__source"), F.lit(BUNDLES)).cast("string")
        draws = _copies(rows, sources, few).select("__source", "pass", "block").distinct().withColumn("colour", bundle)
        draws = stored(draws, "mix-blocks")
    order = F.md5(F.concat_ws(":", F.lit(SEED), "__source", "pass", "block"))
    permuted = Window.partitionBy("colour").orderBy(order, "__source", "pass", "block")
    quota = {r["colour"]: r["n"] for r in draws.groupBy("colour").agg(F.count("*").alias("n")).collect()}
    draws = draws.withColumn("place", (F.row_number().over(permuted) - 1).cast("long"))

    names = [r["__source"] for r in sums if quota.get(r["__source"])] if few else sorted(quota)
    quotas = np.array([quota[n] for n in names], np.int64)
    shards = int(max(1, min(MAX_SHARDS, -(-words // shard_words))))
    leaves = (
        spark.range(shards)
        .select(F.col("id").alias("shard"))
        .mapInPandas(_leaves(shards, quotas, names), "__source string, shard long, quota long")
        .filter("quota > 0")
        .withColumnRenamed("__source", "colour")
    )
    upto = F.sum("quota").over(Window.partitionBy("colour").orderBy("shard"))
    owned = leaves.withColumn("upto", upto).select("colour", "shard", F.explode(F.expr("sequence(upto - quota, upto - 1)")).alias("place"))
    dealt = stored(draws.join(owned, ["colour", "place"]).select("__source", "pass", "block", "shard"), "mix-draws")
    return Plan(sources, dealt, int(quotas.sum()), shards, few)


def mixed(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` (with __source, __row, __size) once for each time the mix takes them, with shard, place, pass and words.

    Every copy has all words of its row, but the last of a source's mix, which is cut to its first ``words`` words.
    A shard's rows belong in the order of ``place``. Rows without words are never taken.
    """
    dealt = _copies(rows, plan.sources, plan.few).join(_hinted(plan.draws, plan.n_draws <= BROADCAST_DRAWS), ["__source", "pass", "block"])
    place = F.md5(F.concat_ws(":", F.lit(SEED), F.lit("local"), "shard", "pass", "__row"))
    return dealt.withColumn("place", place).drop("__key", "block")


#: Columns that a mix adds.
MIXED = ("mix_shard", "mix_place", "mix_pass", "mix_words")


def repeating(pattern: tuple[float, ...] = (3, 1, 2)):
    """Weights by the order of the sources, repeating a pattern."""

    def weigh(names: list) -> list[float]:
        return [pattern[i % len(pattern)] for i in range(len(names))]

    weigh.by_place = lambda place: F.get(F.array(*[F.lit(float(w)) for w in pattern]), (place % len(pattern)).cast("int"))
    return weigh


def mix_summary(docs: DataFrame, weigh=None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): what the mix takes of each row of ``docs``.

    ``size`` is a text's number of words (null: 0), ``target`` the words wanted of its source, ``taken`` the words that
    the mix has of this row, repeats counted, and ``shards`` the number of shards they are in. A null source is a source
    of its own, sorted last. Rows with the same id and text are taken alike, but for rounding where the mix ends in
    them. An empty table gives no rows; other columns are ignored.
    """
    rows = sized(docs, doc_id, text, source)
    plan = plan_mix(rows, weigh or repeating())
    taken = mixed(rows, plan).groupBy("n").agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("shards"))
    out = rows.join(taken, "n", "left").join(_hinted(plan.sources.select("__source", "source_size", "target"), plan.few), "__source")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("shards", zero).alias("shards")
    )


def mix(docs: DataFrame, weigh=None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix: the columns of ``docs`` and mix_shard, mix_place, mix_pass and mix_words, each shard in its order.

    The cut row of a source has its first words, joined by single spaces, as its text. Rows without words (null and
    empty texts among them) are in no mix; texts may be of any length; an empty table gives no rows. Columns of an
    earlier mix are given anew, all others may have any names.
    """
    docs = docs.drop(*MIXED)
    plan = plan_mix(sized(docs, doc_id, text, source), weigh or repeating())
    body = F.col(f"`{text}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
        _source_key(source).alias("__source"),
        _row_name(doc_id, text).alias("__row"),
        word_count(body).alias("__size"),
    )
    own = F.col("__doc").getField(text)
    cut = F.when(F.col("words") < F.col("__size"), F.array_join(F.slice(split_words(own), F.lit(1), F.col("words").cast("int")), " ")).otherwise(own)
    columns = [(cut if c == text else F.col("__doc").getField(c)).alias(c) for c in docs.columns]
    extra = [F.col(own).alias(name) for own, name in zip(("shard", "place", "pass", "words"), MIXED, strict=True)]
    out = mixed(rows, plan).select(*columns, *extra)
    return out.repartition(plan.shards, "mix_shard").sortWithinPartitions("mix_shard", "mix_place")
