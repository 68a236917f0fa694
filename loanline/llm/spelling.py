"""Spelling variants: words of the corpus within one edit of each other, found by scans of sorted lists.

Runs of letters are counted in every text and reduced in Spark to the vocabulary. A task walks a sorted list of words as
the edit matrix's rows: words that share a beginning share the rows of it, of which three cells (the band of one edit)
are kept, so a word begins at the row where it leaves the word before it. All words of the list are compared at once;
one whose band exceeds one edit at a beginning is left out of the whole range of words that share it.

For Spark, the vocabulary is cut into lists that hold every pair: of two words one edit apart, either the first or the
second half is equal. A list too large for one task is cut again by the halves of what may still differ, until its words
share all but one place. No pair is lost, and a list has at most ``LIST`` code points that may differ, or the words that
differ in one place, of which the alphabet allows a few thousand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanline.llm.text import raw_bytes, steps, word_spans
from loanline.operators.sizes import broadcast_if_small
from loanline.sources.folders import stored

#: Code points of a vocabulary word, its occurrences, and how many times as frequent its form is.
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: One (document, word) in so many is misspelled on purpose, which makes variants with a known origin.
MISSPELL = 199
#: Code points that may differ, summed over a list; longer lists are cut again.
LIST = 100_000
#: Words longer than this are hashed one by one, all others position by position.
_SHORT = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, np.bool_)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: Lead byte of U+00C0 to U+00FF in UTF-8; each of them has one byte more.
_LEAD = 0xC3


def _hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each word's bytes, carried on from ``state`` (crc32 of what stands before it)."""
    crc = ~state
    sizes = last - first
    order = np.argsort(-sizes, kind="stable")
    sizes, starts, found = sizes[order], first[order], crc[order]
    n_long = int(np.searchsorted(-sizes, -_SHORT, side="left"))
    for place in range(int(sizes[n_long]) if n_long < len(sizes) else 0):
        stop = int(np.searchsorted(-sizes, -place, side="left"))  # words longer than ``place``
        part = slice(n_long, stop)
        found[part] = _CRC[(found[part] ^ data[starts[part] + place]) & 255] ^ (found[part] >> 8)
    found = ~found
    for i in range(n_long):
        found[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes(), int(~crc[order[i]]))
    result = np.empty_like(found)
    result[order] = found
    return result


def _strings(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    sizes = last - first
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    places = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[places]))


def _word_counts(misspell: int, least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, begins = raw_bytes(batch.column(1))
            if not len(data):
                continue
            data = _LOWER[data]
            lead = data == _LEAD
            inside = _ASCII_LETTER[data] | lead
            inside[1:] |= lead[:-1]
            first, last, doc = word_spans(inside.astype(np.uint8), begins, np.array([False, True]))
            if not len(first):
                continue
            before = np.array([zlib.crc32(f"{'null' if d is None else d}:".encode()) for d in batch.column(0).to_pylist()], np.uint32)
            leads = np.concatenate([[0], np.cumsum(lead)])
            length = (last - first) - (leads[last] - leads[first])
            crc = _hashes(data, first, last, before[doc])
            spoiled = crc % misspell == 0
            keep = ~spoiled & (length >= least)
            words = _strings(data, first[keep], last[keep])
            changed = np.flatnonzero(spoiled & (length > least))
            if len(changed):
                texts = _strings(data, first[changed], last[changed]).to_pylist()
                at = crc[changed] % length[changed]
                words = pa.concat_arrays([words, pa.array([t[:i] + t[i + 1 :] for t, i in zip(texts, at.tolist())], pa.large_string())])
            counted = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], names=["word", "n"])

    return count


def vocabulary(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspell: int = MISSPELL
) -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, of at least ``least`` code points and ``least_count`` occurrences.

    Where crc32 of ``<doc_id>:<run>`` is a multiple of ``misspell``, the run's code point at that hash modulo its length is left out.
    Equal words are counted together within a task before they are shuffled.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInArrow(_word_counts(misspell, least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _near_in_list(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in the sorted list ``words``, all different, whose words are one edit apart; each in both directions."""
    n, width = len(words), max(map(len, words))
    plain = np.array(words, f"U{max(width, 1)}").view(np.uint32).reshape(n, -1)
    codes = np.zeros((n, width + 3), np.uint32)  # a column in front and two behind, so that the band never leaves the matrix
    codes[:, 1 : width + 1] = plain[:, :width]
    sizes = np.array([len(w) for w in words])
    unequal = np.ones((n - 1, width + 1), np.bool_)
    unequal[:, :width] = plain[1:, :width] != plain[:-1, :width]
    shared = [0, *unequal.argmax(axis=1).tolist()]
    left, right = [], []
    start = np.array([[2], [0], [1]], np.int8).repeat(n, axis=1)
    rows = [(np.arange(n), start)]  # by depth: words still within one edit, and their cells before, on and after the diagonal
    for k in range(n):
        depth, end = shared[k], len(words[k])
        del rows[depth + 1 :]
        while depth < end:
            who, (before, on, after) = rows[depth]
            depth += 1
            other = codes[who, depth - 1 : depth + 2] != codes[k, depth]
            before = np.minimum(before + other[:, 0], on + 1)
            on = np.minimum(np.minimum(on + other[:, 1], after + 1), before + 1)
            after = np.minimum(after + other[:, 2], on + 1)
            near = (np.minimum(np.minimum(before, on), after) <= 1).nonzero()[0]
            if len(near) <= 1:
                break  # the word itself, so no other word of the list begins like this
            rows.append((who[near], np.array([before[near], on[near], after[near]])))
        else:
            who, cells = rows[end]
            gap = sizes[who] - end + 1
            inside = ((gap >= 0) & (gap <= 2)).nonzero()[0]
            found = who[inside[cells[gap[inside], inside] == 1]]
            left.append(np.full(len(found), k))
            right.append(found)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


_PAIR = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, middle, word, n) in the order of lists and middles; a list may run over several batches."""
    kept, open_list, words, others, counts = ([], [], []), None, [], [], []

    def close() -> None:
        middles, names, numbers = kept
        if len(middles) > 1:
            left, right = _near_in_list(middles)
            words.extend(names[i] for i in left.tolist())
            others.extend(names[i] for i in right.tolist())
            counts.extend(numbers[i] for i in right.tolist())
        for part in kept:
            part.clear()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(others, pa.string()), pa.array(counts, pa.int64())], schema=_PAIR)
        for part in (words, others, counts):
            part.clear()
        return batch

    for batch in batches:
        for name, middle, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if name != open_list:
                close()
                open_list = name
            kept[0].append(middle)
            kept[1].append(word)
            kept[2].append(n)
        if words:
            yield rows()
    close()
    yield rows()


def _lists(word: Column, length: Column, size: Column, head: Column, tail: Column) -> Column:
    """The two lists in which a word may meet others one edit away: all but either half of its middle is equal.

    ``size`` is the length of the shorter word of a pair; the middle is what ``head`` code points in front and ``tail``
    behind leave.
    """
    half = F.floor((size - head - tail) / 2).cast("int")
    behind = F.struct((head + half).alias("head"), tail.alias("tail"))
    front = F.struct(head.alias("head"), (size - head - half).alias("tail"))

    def cut(part: Column) -> Column:
        begin, end = part["head"], part["tail"]
        equal = F.concat_ws("/", size, begin, end, F.substring(word, F.lit(1), begin), F.substring(word, length - end + 1, end))
        middle = F.substring(word, begin + 1, length - begin - end)
        return F.struct(equal.alias("list"), size.alias("size"), begin.alias("head"), end.alias("tail"), middle.alias("middle"))

    return F.transform(F.array(behind, front), cut)


def near_words(vocab: DataFrame, limit: int = LIST) -> DataFrame:
    """(word, other, other_n): all pairs of different words of ``vocab`` (word, n) one edit apart, in both directions, once each."""
    length = F.length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("size")
    none = F.lit(0)
    level = (
        vocab.select("word", "n", length.alias("length"), sizes)
        .select("word", "n", "length", F.explode(_lists(F.col("word"), F.col("length"), F.col("size"), none, none)).alias("l"))
        .select("word", "n", "length", "l.*")
    )
    pairs = None
    while True:
        level = stored(level, "spelling-lists")
        sums = level.groupBy("list").agg(F.sum(F.length("middle") + 1).alias("points"), F.max(F.col("size") - F.col("head") - F.col("tail")).alias("open"))
        large = stored(sums.filter((F.col("points") > limit) & (F.col("open") > 1)).select("list"), "spelling-large")
        again = not large.isEmpty()
        small = level.join(broadcast_if_small(large), "list", "left_anti") if again else level
        ordered = small.select("list", "middle", "word", "n").repartition("list").sortWithinPartitions("list", "middle")
        found = ordered.mapInArrow(_scan_lists, "word string, other string, other_n long")
        pairs = found if pairs is None else pairs.unionByName(found)
        if not again:
            return pairs.distinct()
        args = [F.col(c) for c in ("word", "length", "size", "head", "tail")]
        level = (
            level.join(broadcast_if_small(large), "list", "left_semi")
            .select("word", "n", "length", F.explode(_lists(*args)).alias("l"))
            .select("word", "n", "length", "l.*")
        )


def group_variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = FORM_RATIO,
    misspell: int = MISSPELL,
    limit: int = LIST,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of the vocabulary with what it is a variant of.

    ``form`` is the near word (one code point inserted, deleted or replaced) of largest count, the smallest in code-point
    order among equals, if it has at least ``ratio`` times the word's count, else null. ``root`` is where forms lead.
    A null or empty text has no words; a null doc_id counts as ``null`` in the hash; repeated rows count as often as they
    are there; texts and words may be of any length; an empty table gives no rows; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in circles")
    vocab = stored(vocabulary(docs, doc_id, text, least, least_count, misspell), "spelling-vocabulary")
    best = F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))
    near = near_words(vocab, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    named = vocab.join(near, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    forms = stored(
        named.select(
            "word",
            F.when(is_form, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, -F.col("best.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # Counts grow by the ratio from step to step; each round doubles the steps taken.
    links = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        links = stored(links, "spelling-roots")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(further, "root", "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            break
        links = joined.select("word", F.coalesce("next", "root").alias("root"))
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
