"""SimHash fingerprints, linked by multi-index hashing.

A fingerprint of 64 bits has two segments of 32. Two fingerprints that differ in at most two bits agree in one segment,
or differ in one bit of each. So the table of segments is probed with the small Hamming balls around each segment
(radius 0 for both, radius 1 for the first), and every match is verified on the complete distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanline.llm.text import apart, raw_bytes, row_key, steps, word_spans
from loanline.operators.components import connected_components
from loanline.sources.folders import stored

#: Bucket size above which a segment's bucket is divided by the halves of the other segment.
CROWDED = 64
DISTANCE = 2
SEED = 42
HALF = (1 << 32) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.bool_)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _spaced(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and their new first and past-the-last bytes."""
    kept = np.zeros(len(data) + 1, np.int64)
    lengths = last - first
    to = np.concatenate([[0], np.cumsum(lengths + 1)])
    marks = kept
    np.add.at(marks, first, 1)
    np.add.at(marks, last, -1)
    letters = data[np.cumsum(marks[:-1]) > 0] if len(first) else data[:0]
    out = np.full(int(to[-1]), 32, np.uint8)
    letter_at = np.arange(len(letters)) + np.repeat(np.arange(len(first)), lengths)
    out[letter_at] = letters
    return out.tobytes(), to[:-1], to[:-1] + lengths


def fingerprints_of(array: pa.Array, width: int = 3) -> np.ndarray:
    """Fingerprint of each text: bit b is 1 if it is set in over half of the hashes of all its word shingles."""
    data, begins = raw_bytes(array)
    first, last, owner = word_spans(data, begins, _WORD)
    joined, first, last = _spaced(_LOWER[data], first, last)
    counts = np.bincount(owner, minlength=len(array)).astype(np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts
    shingles = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    base = np.repeat(starts, shingles)
    index = np.arange(len(base)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    opening = base + index
    closing = np.minimum(opening + width - 1, np.repeat(ends, shingles) - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(first[opening].tolist(), last[closing].tolist(), strict=True)),
        dtype=np.uint64,
        count=len(opening),
    )
    out = np.zeros(len(array), np.uint64)
    filled = np.flatnonzero(shingles)
    if len(filled):
        cuts = (np.cumsum(shingles) - shingles)[filled]
        for bit in range(64):
            votes = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), cuts)
            out[filled] |= (2 * votes > shingles[filled]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed long. A null, empty or wordless text has 0."""

    @F.arrow_udf("long")
    def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            parts = [
                fingerprints_of(part.column(0)).view(np.int64)
                for part in steps(iter([pa.record_batch([array], names=["text"])]))
            ]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return docs.withColumn(name, fingerprint(F.col(text)))


def _balls(value: Column, bits: int) -> Column:
    """The value and each value with one of its zero bits set: of two that differ in one bit, the smaller finds the other."""
    flips = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
        lambda x: x != value,
    )
    return F.concat(F.array(value), flips)


def fingerprint_links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: all pairs of distinct ``fingerprint`` values at a distance of one or two bits, each once.

    A bucket with more than ``crowded`` fingerprints is divided by the 16-bit halves of the other segment, which are
    probed in the same way; this loses no pair, and leaves no bucket whose members are all compared with one another.
    """
    p = F.col("fingerprint")
    homes = prints.select(
        p,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("segment"), F.shiftrightunsigned(p, 32).alias("value"), p.bitwiseAND(F.lit(HALF)).alias("rest")),
                F.struct(F.lit(1).alias("segment"), p.bitwiseAND(F.lit(HALF)).alias("value"), F.shiftrightunsigned(p, 32).alias("rest")),
            )
        ).alias("at"),
    ).select("fingerprint", "at.*")
    full = (
        homes.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("segment", "value", F.lit(True).alias("full"))
    )
    high = F.shiftright(F.col("rest"), 16) + F.lit(1 << 17)
    low = F.col("rest").bitwiseAND(F.lit(0xFFFF)) + F.lit(1 << 18)
    whole = F.array(F.lit(0).cast("long"))
    table = homes.join(full, ["segment", "value"], "left").select(
        "segment",
        "value",
        F.explode(F.when(F.col("full"), F.array(high, low)).otherwise(whole)).alias("part"),
        F.col("fingerprint").alias("found"),
    )
    probes = homes.select(
        "fingerprint",
        "segment",
        "rest",
        F.col("value").alias("own"),
        F.explode(F.when(F.col("segment") == 0, _balls(F.col("value"), 32)).otherwise(F.array("value"))).alias("value"),
    )
    near = F.col("value") != F.col("own")
    high_ball = F.transform(_balls(F.shiftright(F.col("rest"), 16), 16), lambda x: x + F.lit(1 << 17))
    parts = F.when(near, F.array(high, low)).otherwise(F.concat(high_ball, F.array(low)))
    probes = probes.join(full, ["segment", "value"], "left").select(
        "segment", "value", F.explode(F.when(F.col("full"), parts).otherwise(whole)).alias("part"), "fingerprint"
    )
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("found")))
    return (
        probes.join(table, ["segment", "value", "part"])
        .filter(distance.between(1, DISTANCE))
        .select(F.least("fingerprint", "found").alias("a"), F.greatest("fingerprint", "found").alias("b"))
        .distinct()
    )


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row, fingerprint, star, component_id) of each row; ``star`` names the group."""
    marked = stored(
        with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select(
            "doc_id", row_key().alias("row"), "fingerprint"
        ),
        "prints",
    )
    prints = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-prints")
    members = connected_components(fingerprint_links(prints.select("fingerprint"))).select(
        F.col("node").alias("fingerprint"), F.col("component").alias("star")
    )
    grouped = prints.join(members, "fingerprint", "left").withColumn("star", F.coalesce("star", "fingerprint"))
    least = grouped.groupBy("star").agg(F.min("least").alias("component_id"))
    return marked.join(grouped.join(least, "star").select("fingerprint", "star", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of ``docs``.

    Texts whose fingerprints differ in two bits or fewer are linked; ``component_id`` is the smallest doc_id that links
    reach. Documents are reduced to distinct fingerprints first, so copies make no pairs. A null, empty or wordless text
    has the fingerprint zero and is linked like any other; texts of fewer than three words have one shingle, of all
    their words. Repeated rows stay as often as they come; a null doc_id is never the smallest unless all are null.
    Other columns are ignored, an empty table gives no rows.
    """
    return _grouped(docs, doc_id, text).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those of a group but one: that with the smallest doc_id, all columns as they are.

    Where rows of a group share that doc_id (or all have a null one), one of the texts stays, once. Null, empty and
    wordless texts are one group; texts may be of any length, columns may have any names.
    """
    inner, (doc_id, text) = apart(docs, doc_id, text)
    heads = (
        _grouped(inner, doc_id, text)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("star")
        .agg(F.min("row").alias("__head"))
    )
    kept = inner.withColumn("__row", row_key(doc_id, text)).join(heads, F.col("__row") == F.col("__head"), "left_semi")
    first = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    return kept.withColumn("__first", first).filter("__first = 1").drop("__first", "__row").toDF(*docs.columns)
