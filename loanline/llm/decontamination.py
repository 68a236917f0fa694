"""Benchmark decontamination by winnowing.

From every run of ``span`` words the least k-gram hash of a sliding window is kept, so two texts that share ``span``
words share a kept fingerprint at the same place. A fingerprint that the benchmark may have is extended to the windows
it was kept from; those are joined by hash and by their words. A shared run shorter than a window joins nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanline.llm.text import apart, raw_bytes, row_key, steps, word_spans
from loanline.sources.folders import stored

SPAN = 13
#: Words of a fingerprint; a window holds SPAN - GRAM + 1 of them.
GRAM = 7
#: Bits of the filter that documents' fingerprints pass before the shuffle. Its size is fixed: 512 kB.
FILTER_BITS = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, np.bool_)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running sums of byte values times powers of one odd base."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_MULTIPLIER, len(data)), out=sums[1:])
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    return _mixed((sums[last] - sums[first]) * _powers(inverse, len(data) + 1)[first] + (last - first).astype(np.uint64))


def _grams(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they lie in one text."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(_MULTIPLIER) + words[i : i + n]
    return _mixed(total + np.uint64(size)), owner[:n] == owner[size - 1 : size - 1 + n]


def _picks(words: np.ndarray, owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each window of ``span`` words: whether it lies in one text, its least gram, where that begins; words of a gram."""
    size = min(GRAM, span)
    grams, _ = _grams(words, owner, size)
    window = span - size + 1
    n = max(0, len(words) - span + 1)
    whole = owner[:n] == owner[span - 1 : span - 1 + n]
    best, least = np.zeros(n, np.int64), grams[:n].copy()
    for i in range(1, window):
        lower = grams[i : i + n] <= least  # the last of equals
        best[lower] = i
        least[lower] = grams[i : i + n][lower]
    return whole, least, np.arange(n) + best, size


def winnowed(words: np.ndarray, owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first words, fingerprints, words of a fingerprint) kept for shared runs of ``span`` words."""
    whole, least, places, size = _picks(words, owner, span)
    at, first = np.unique(places[whole], return_index=True)
    return at, least[whole][first].view(np.int64), size


def extended(words: np.ndarray, owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, fingerprints, hashes of all words) of the windows to which kept fingerprints extend."""
    whole, least, _, _ = _picks(words, owner, span)
    every, _ = _grams(words, owner, span)
    at = np.flatnonzero(whole)
    return at, least[at].view(np.int64), every[at].view(np.int64)


class _Words:
    """Lower-cased words of the texts of a batch."""

    def __init__(self, array: pa.Array) -> None:
        data, begins = raw_bytes(array)
        self.data = _LOWER[data]
        self.first, self.last, self.owner = word_spans(self.data, begins, _WORD)
        self.hashes = word_hashes(self.data, self.first, self.last)
        self.counts = np.bincount(self.owner, minlength=len(array)).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.text = self.data.tobytes()

    def window(self, at: int, span: int) -> str:
        """The ``span`` words from a word on."""
        pairs = zip(self.first[at : at + span].tolist(), self.last[at : at + span].tolist(), strict=True)
        return b" ".join([self.text[a:b] for a, b in pairs]).decode()


def _bench_windows(spans: list[int]):
    """Windows of items: of ``span`` words of longer ones, and of the whole length of shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, items = _Words(batch.column(1)), batch.column(0).to_pylist()
            out = []
            for span in spans:
                own = words.counts >= span if span == SPAN else words.counts == span
                for i, fingerprint, whole in zip(*(x.tolist() for x in extended(words.hashes, words.owner, span)), strict=True):
                    if own[words.owner[i]]:
                        out.append((items[words.owner[i]], span, fingerprint, whole, words.window(i, span)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), _BENCH, strict=True)] if out else [pa.array([], t) for t in _BENCH],
                names=["item", "span", "print", "whole", "words"],
            )

    return run


_BENCH = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
_CANDIDATE = pa.struct([("span", pa.int32()), ("whole", pa.int64()), ("at", pa.int64()), ("words", pa.string())])


def _doc_windows(spans: list[int], filters):
    """Each document's word count, and its windows whose fingerprint and whole hash may be in the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has_print, has_whole = (np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").view(np.bool_) for b in filters.value)
        for batch in steps(batches):
            words = _Words(batch.column(2))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for span in spans:
                at, prints, whole = extended(words.hashes, words.owner, span)
                likely = has_print[prints & (FILTER_BITS - 1)] & has_whole[whole & (FILTER_BITS - 1)]
                for i, hashed in zip(at[likely].tolist(), whole[likely].tolist(), strict=True):
                    owner = int(words.owner[i])
                    place = i - int(words.ends[owner] - words.counts[owner])
                    found[owner].append({"span": span, "whole": hashed, "at": place, "words": words.window(i, span)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words.counts), pa.array(found, pa.list_(_CANDIDATE))],
                names=["doc_id", "row", "n_words", "found"],
            )

    return run


def _filter(hashes: DataFrame, name: str) -> bytes:
    """The low bits of all hashes in a bitmap of FILTER_BITS; at most FILTER_BITS / 64 rows reach the driver."""
    place = F.col(name).bitwiseAND(F.lit(FILTER_BITS - 1))
    blocks = (
        hashes.select(F.shiftright(place, 6).alias("block"), F.expr(f"shiftleft(1L, cast({name} & 63 as int))").alias("bit"))
        .groupBy("block")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[blocks["block"].to_numpy(np.int64)] = blocks["bits"].to_numpy(np.int64)
    return bits.tobytes()


def _covered(spans: str) -> str:
    """SQL: how many places the sorted (low, high) pairs cover."""
    return f"""aggregate({spans}, named_struct('n', 0L, 'up', 0L),
        (s, x) -> named_struct('n', s.n + greatest(x.high - greatest(x.low, s.up), 0L), 'up', greatest(s.up, x.high)), s -> s.n)"""


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, row, n_words, n_hit, n_items, items, items_sha256, contaminated): a row for each row of ``docs``.

    Words are runs of a-z, 0-9 and characters past ASCII, A-Z lower-cased. A window is 13 consecutive words of an item,
    or all words of a shorter one; a document word inside any occurrence of a window is hit. ``items`` has the ids of
    the items with an occurring window, as sorted strings; a null id is left out of them but its windows count. A
    document is contaminated if at least one of its words in 20 is hit. A null, empty or wordless text has no words and
    is clean; items without words have no window; an empty benchmark hits nothing; repeated rows and items change
    nothing; other columns are ignored. ``row`` names equal rows (see ``row_key``).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text"))
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lengths = items.select(F.least(F.size(F.regexp_extract_all(F.lower("text"), F.lit(word), 0)), F.lit(SPAN)).alias("n")).distinct()
    spans = sorted(r.n for r in lengths.collect() if r.n and r.n > 0)  # at most 13 values
    windows = stored(
        items.mapInArrow(_bench_windows(spans), "item string, span int, print long, whole long, words string")
        .groupBy("span", "print", "whole", "words")
        .agg(F.collect_set("item").alias("items")),
        "benchmark-windows",
    )
    passes = spark.sparkContext.broadcast((_filter(windows, "print"), _filter(windows, "whole")))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    marked = stored(
        own.select("doc_id", row_key().alias("row"), "text").mapInArrow(
            _doc_windows(spans, passes),
            f"doc_id {kind}, row string, n_words long, found array<struct<span int, whole long, at long, words string>>",
        ),
        "document-windows",
    )
    # Distinct windows are few beside their places: a template of many items and documents is one row on this side.
    hits = (
        marked.select("row", F.explode("found").alias("f"))
        .select("row", "f.*")
        .join(windows.select("span", "whole", "words", "items"), ["span", "whole", "words"])
        .select("row", F.col("at").alias("low"), (F.col("at") + F.col("span")).alias("high"), "items")
    )
    runs = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("runs"), F.flatten(F.collect_set("items")).alias("items"))
    runs = runs.select("row", F.expr(_covered("runs")).alias("n_hit"), F.sort_array(F.array_distinct("items")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return marked.select("doc_id", "row", "n_words").join(runs, "row", "left").select(
        "doc_id",
        "row",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        found.alias("items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are, whatever their names.

    Null and wordless texts stay, repeated rows stay or go together, texts may be of any length; an empty benchmark
    takes nothing.
    """
    inner, (doc_id, text) = apart(docs, doc_id, text)
    dirty = contamination(inner, benchmark, doc_id, text).filter("contaminated").select(F.col("row").alias("__dirty")).distinct()
    marked = inner.withColumn("__row", row_key(doc_id, text))
    return marked.join(dirty, F.col("__row") == F.col("__dirty"), "left_anti").drop("__row").toDF(*docs.columns)
