"""What the text operators share: tables, row keys, and words as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules, as a class body for regular expressions.
BLANK = r"\x20\x09-\x0D"
#: Bytes of text that one step of a Python task works on; bounds its memory whatever the batch of rows.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row for joins back to it: equal only for rows with the same id (null too) and the same text."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    body = F.col(text)
    return F.concat_ws(":", name, F.hex(F.xxhash64(body)), F.coalesce(F.octet_length(body), F.lit(-1)))


def apart(docs: DataFrame, *names: str | None) -> tuple[DataFrame, list[str | None]]:
    """``docs`` with its columns named c0, c1, ..., which nothing that an operator adds is called, and the new names of ``names``.

    ``toDF(*docs.columns)`` gives the old names back.
    """
    found = [None if name is None else f"c{docs.columns.index(name)}" for name in names]
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), found


def fold_of(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as 'null'."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))) % folds


def split_words(text: Column) -> Column:
    """Array of the runs of characters that are no white space; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), lambda word: word != "")


def word_count(text: Column) -> Column:
    """How many words ``split_words`` has, without keeping them."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{BLANK}]+|[{BLANK}]+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"[{BLANK}]+"))).cast("long")


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more entry than texts); null is empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    begins = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[begins[0] : begins[-1]], begins - begins[0]


def word_spans(data: np.ndarray, begins: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte past the last, text number) of each word: runs of bytes marked in ``in_word`` inside one text."""
    inside = np.zeros(len(data) + 2, np.bool_)
    inside[1:-1] = in_word[data]
    opens = inside[1:] & ~inside[:-1]
    closes = inside[:-1] & ~inside[1:]
    edges = begins[1:-1]
    joined = edges[inside[edges] & inside[edges + 1]]  # a word that touches the next text's first word
    opens[joined] = True
    closes[joined] = True
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return first, last, np.searchsorted(begins, first, side="right") - 1
