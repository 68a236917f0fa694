"""How five document filters interact, in every order in which they may be applied.

Four filters look at a text alone and are columns of one projection. The fifth, that an earlier document has the same
text, is an existential self-join: a left-semi join on hash, exact text and smaller id. Its ids are put under those of
the other failures, and the combinations of failures are counted; all orders follow from these counts, of which there
are at most 32 a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanline.llm.text import split_words
from loanline.operators.sizes import broadcast_if_small
from loanline.sources.folders import stored

#: Filters by letter; bit k of a combination stands for the k-th.
FILTERS = "ABCDE"
#: A hot text's copies are compared in so many tasks at most, each with about so many rows.
SALTS, ROWS_A_SALT = 64, 2_000

_E = 1 << FILTERS.index("E")
_GOOD, _TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; a null text is empty.

    A: under 100 words; B: under 80 % distinct words; C: over 10 % capital letters A-Z; D: a character of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words = split_words(text)
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    bits = [F.when(test, F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(tests)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def earlier_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hash): of each row with a text that a row of smaller id has as well; a null text is empty, a null id in no order.

    Rows are counted by hash first, and only texts of hashes that several ids share are shuffled, on the side of the
    smaller ids once a text and task. A hash of many rows is dealt to several tasks, with its texts in each of them.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hash")).filter("doc_id IS NOT NULL")
    counts = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    salts = F.least(F.ceil(F.col("n") / ROWS_A_SALT), F.lit(SALTS)).cast("int").alias("salts")
    shared = counts.filter("least < most").select("hash", "least", salts)
    held = stored(rows.join(broadcast_if_small(shared), "hash"), "audit-held")
    later = held.filter("doc_id > least").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    first = held.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("first"))
    first = first.select("hash", "text", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    smaller = (later["hash"] == first["hash"]) & (later["salt"] == first["salt"]) & (later["text"] == first["text"])
    return later.join(first, smaller & (first["first"] < later["doc_id"]), "left_semi").select("doc_id", "hash")


def combinations(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, bits, n, good, toxic): rows by part and combination of failures, and how many are labelled quality 1 and toxic 1.

    An id labelled several times has a label if one of its rows does; a null ``part`` is the empty string.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(body).alias("hash"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        failures(F.col(f"`{text}`")).alias("bits"),
    )
    marks = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, _GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, _TOXIC).otherwise(0)).alias("toxic")
    )
    marks = marks.select(F.col("doc_id"), (F.col("good") + F.col("toxic")).alias("marks"))
    own = own.groupBy("doc_id", "hash", "part", "bits").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    own = own.select("doc_id", "hash", "part", "n", (F.col("bits") + F.coalesce("marks", F.lit(0))).alias("bits"))
    copies = earlier_copies(docs, doc_id, text).select("doc_id", "hash", F.lit(None).alias("part"), F.lit(0).cast("long").alias("n"), F.lit(_E).alias("bits"))
    # Rows of one id and text share their failures; only their parts may differ.
    whole = own.unionByName(copies).groupBy("doc_id", "hash").agg(
        F.bit_or("bits").alias("bits"), F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", "n"))).alias("parts")
    )
    each = whole.select("bits", F.explode("parts").alias("p")).select("p.part", "p.n", "bits")
    counted = each.groupBy("part", "bits").agg(F.sum("n").alias("n"))
    held = lambda bit: F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n")).otherwise(0))
    return counted.groupBy("part", F.col("bits").bitwiseAND(_GOOD - 1).alias("bits")).agg(
        F.sum("n").alias("n"), held(_GOOD).alias("good"), held(_TOXIC).alias("toxic")
    )


def _steps() -> Column:
    """All (order, step, own bit, bits before) of all orders of the filters, as an array."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append("('{}', {}, {}, {})".format("".join(order), step, bit, before))
            before |= bit
    fields = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    return F.expr(f"CAST(array({', '.join(rows)}) AS {fields})")


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included.

    One row for each part (value of ``part``; null: empty string), order of the five filters and step in it. ``kept``:
    rows that pass up to here; ``removed``: fail here first; ``redundant``: fail here, but were gone; ``unique_fails``:
    fail this filter only; ``good_lost`` and ``toxic_lost``: removed here, with label quality 1 and toxic 1; ``shapley``:
    what the filter removes, summed over all orders. Null and empty texts are equal and are rows like others (they fail
    A); repeated rows count each; a null doc_id is no copy and has no label; texts may be of any length; an empty table
    gives no rows; other columns are ignored.
    """
    counts = combinations(docs, labels, doc_id, text, part)
    orders = counts.select("*", F.explode(_steps()).alias("s")).select("part", "n", "good", "toxic", "bits", "s.*")
    fails, gone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda test, value: F.sum(F.when(test, value).otherwise(F.lit(0)).cast("long"))
    n = F.col("n")
    # Of k filters that a row fails, each is the first in one of k of all orders.
    share = F.lit(factorial(len(FILTERS))) / F.bit_count("bits")
    return orders.groupBy("part", "filter_order", "step").agg(
        total(F.col("bits").bitwiseAND(F.col("bit").bitwiseOR(F.col("before"))) == 0, n).alias("kept"),
        total(fails & ~gone, n).alias("removed"),
        total(fails & gone, n).alias("redundant"),
        total(F.col("bits") == F.col("bit"), n).alias("unique_fails"),
        total(fails & ~gone, F.col("good")).alias("good_lost"),
        total(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        total(fails, n * share.cast("long")).alias("shapley"),
    )
