"""Line dedup: chunks of lines that other documents have too are removed, with DataFrame functions alone.

A stretch is the shortest run of lines from one line on, or back from it, that has more than ``min_words`` words. A
rolling hash over the line hashes chooses a boundary in each: the least value inside it. Equal stretches have equal
boundaries wherever they stand, and neighbouring stretches mostly share theirs, so a text has few. Only boundaries that
several documents have can lie in a repeated passage; the chunks around those are matched by the hash over all their
line hashes, and compared byte by byte before anything is removed. A repeated run of lines of more than ``min_words``
words is a union of stretches, so every one is found, whatever surrounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanline.llm.text import BLANK, apart, row_key
from loanline.sources.folders import stored

MIN_WORDS = 50


def _words(line: str) -> Column:
    parts = F.split(line, f"[{BLANK}]+")
    edges = (F.element_at(parts, 1) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.size(parts) - edges, F.lit(0)).cast("long")


def rolled(before: Column, hash_: Column) -> Column:
    """The rolling hash (cyclic polynomial) of two lines: the earlier one's hash turned by a bit, xor the later one's.

    It rolls over two lines, since a stretch may have no more; null where there is no line before.
    """
    turned = F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63))
    return turned.bitwiseXOR(hash_)


def line_chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, boundary, hash, low, high, start, length): the chunks of each distinct row of (row, doc_id, text).

    ``boundary`` is the least rolling hash inside the chunk, of a chunk of one line that line's hash. ``low`` and
    ``high`` are line numbers from 0, both inside; ``start`` (from 1) and ``length`` are in characters. Lines without
    words are not counted. A text of ``min_words`` words or fewer has no chunk.
    """
    lines = (
        docs.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .select("row", "doc_id", "at", F.xxhash64("line").alias("hash"), _words("line").alias("words"), F.length("line").alias("chars"))
        .repartition("row")
        .dropDuplicates(["row", "at"])
    )
    in_order = Window.partitionBy("row").orderBy("at")
    lines = (
        lines.withColumn("upto", F.sum("words").over(in_order))
        .withColumn("ends", F.sum(F.col("chars") + 1).over(in_order))
        .filter("words > 0")
        .withColumn("before", F.col("upto") - F.col("words"))
        .withColumn("rolled", rolled(F.lag("hash").over(in_order), F.col("hash")))
        .withColumn("rolls", F.lead("rolled").over(in_order))
    )
    ahead = Window.partitionBy("row").orderBy("before").rangeBetween(0, min_words)
    behind = Window.partitionBy("row").orderBy("upto").rangeBetween(-min_words, 0)
    # the pairs of lines inside a stretch: all but its first line with the one before, all but its last with the next
    inside = [
        F.min("rolled").over(Window.partitionBy("row").orderBy("before").rangeBetween(1, min_words)),
        F.min("rolls").over(Window.partitionBy("row").orderBy("upto").rangeBetween(-min_words, -1)),
    ]
    begins = F.col("ends") - F.col("chars")
    runs = [
        F.struct(
            F.coalesce(least, F.col("hash")).alias("boundary"),
            F.xxhash64(F.collect_list("hash").over(w)).alias("hash"),
            F.min("at").over(w).alias("low"),
            F.max("at").over(w).alias("high"),
            F.min(begins).over(w).alias("start"),
            (F.max("ends").over(w) - F.min(begins).over(w)).alias("length"),
            F.sum("words").over(w).alias("words"),
        )
        for w, least in zip((ahead, behind), inside, strict=True)
    ]
    return (
        lines.select("row", "doc_id", runs[0].alias("forward"), runs[1].alias("backward"))
        .select("row", "doc_id", F.explode(F.array_distinct(F.array("forward", "backward"))).alias("run"))
        .filter(F.col("run.words") > min_words)
        .select("row", "doc_id", "run.boundary", "run.hash", "run.low", "run.high", "run.start", "run.length")
        .distinct()
    )


def _several(chunks: DataFrame, key: str) -> DataFrame:
    """(key, least): the values that several documents have, at least one of them named, and the smallest doc_id."""
    seen = chunks.groupBy(key).agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("unnamed")
    )
    return seen.filter((F.col("least") < F.col("most")) | (F.col("unnamed") & F.col("least").isNotNull())).select(key, "least")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks whose hash several documents have, with ``own``: whether the smallest of these doc_ids has it.

    Looked for around the boundaries that several documents have alone, which loses none: equal chunks have one boundary.
    """
    near = chunks.join(_several(chunks, "boundary"), "boundary", "left_semi").drop("boundary")
    return near.join(_several(near, "hash"), "hash").withColumn("own", F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False)))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``, and the columns ``__lines`` and ``__removed`` (line counts).

    A run of lines of more than ``min_words`` words that several doc_ids have stays where the doc_id is smallest and
    goes from all others. Repeats within one doc_id stay. A null doc_id owns nothing: it loses what any named document
    has, and what only null ids share stays. A null text stays null, an empty one empty; lines without words stay, and
    do not count when chunks are compared. Repeated rows are treated alike, all other columns are kept.
    """
    marked = docs.withColumn("__row", row_key(doc_id, text))
    plain = marked.select(F.col("__row").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    chunks = stored(line_chunks(plain, min_words), "line-chunks")
    found = (
        repeated_chunks(chunks)
        .groupBy("row")
        .agg(F.collect_list(F.struct("hash", "own", "low", "high", "start", "length")).alias("__found"))
        .withColumnRenamed("row", "__of")
    )
    joined = marked.join(found, F.col("__row") == F.col("__of"), "left").drop("__of")
    joined = stored(joined, "line-marked")

    body = F.col(f"`{text}`")
    pieces = (
        joined.filter("__found is not null")
        .select(F.col("__row").alias("row"), body.alias("text"), F.explode("__found").alias("f"))
        .select(
            "row",
            "f.hash",
            "f.own",
            "f.low",
            "f.high",
            F.regexp_replace(F.expr("substring(text, cast(f.start as int), cast(f.length as int))"), "\n[\\x20\\x09\\x0B-\\x0D]*(?=\n)", "").alias("bytes"),
        )
    )
    # Equal bytes are reduced before the shuffle, so a passage that very many documents have is no hot key.
    unowned = pieces.groupBy("hash", "bytes").agg(F.max("own").alias("owned")).filter("not owned").select("hash", "bytes")
    differing = (
        pieces.join(stored(unowned, "line-variants"), ["hash", "bytes"])
        .groupBy(F.col("row").alias("__of"))
        .agg(F.collect_set(F.struct("low", "high")).alias("__differing"))
    )
    differing = stored(differing, "line-differing")  # nearly always none, so Spark need not shuffle the texts for it
    checked = joined.join(differing, F.col("__row") == F.col("__of"), "left").drop("__of")

    gone = F.filter(
        F.col("__found"),
        lambda f: ~f["own"] & ~F.coalesce(F.array_contains("__differing", F.struct(f["low"], f["high"])), F.lit(False)),
    )
    numbers = F.array_distinct(F.flatten(F.transform(gone, lambda f: F.sequence(f["low"], f["high"]))))
    count = F.size(F.split(body, "\n"))
    rest = F.transform(
        F.array(F.split(body, "\n")),  # one value, so that the text is split once
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__numbers")), lambda i: F.get(lines, i)), "\n"
        ),
    )
    return (
        checked.withColumn("__numbers", F.when(F.col("__found").isNotNull(), numbers))
        .withColumn("__removed", F.coalesce(F.size("__numbers"), F.lit(0)).cast("long"))
        .withColumn("__removed", F.greatest("__removed", F.lit(0).cast("long")))
        .withColumn("__lines", F.coalesce(F.when(body.isNotNull(), count), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col("__removed") > 0, F.get(rest, F.lit(0))).otherwise(body))
        .drop("__numbers", "__found", "__differing", "__row")
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): see ``without_repeats``."""
    out = without_repeats(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), min_words=min_words)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, count: str | None = None
) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``, without the rows that this leaves with no word.

    ``count`` names a column with the length of the text, which follows it where lines were removed. Nulls, empty texts
    and repeated rows as in ``without_repeats``; rows without words before stay; columns may have any names.
    """
    inner, (doc_id, text, length) = apart(docs, doc_id, text, count)
    out = without_repeats(inner, doc_id, text, min_words)
    if length:
        anew = F.length(text).cast(docs.schema[count].dataType)
        out = out.withColumn(length, F.when(F.col("__removed") > 0, anew).otherwise(F.col(length)))
    left = (F.col("__removed") == 0) | F.col(text).rlike(f"[^{BLANK}]")
    return out.filter(left).select(*inner.columns).toDF(*docs.columns)
