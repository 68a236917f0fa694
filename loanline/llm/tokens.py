"""Token counts without token ids: pieces are counted once per distinct pre-token of the corpus.

Documents are read in blocks. A block has its distinct pre-tokens and, for each document, how often it has which. The
pre-tokens of all blocks meet in one shuffle, where each distinct one is tokenized once; the counts are joined back to
the blocks, and each document's count is the sum of its frequencies times them. Only special strings are counted in place.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loanline.llm.text import steps
from loanline.sources.folders import stored

#: Bytes of text in a block.
BLOCK_BYTES = 32 << 20
LIMIT = 2048

# ---- fixed values: how the tokenizer files are set up for which the short way below finds the same pre-tokens ----
_SHORT = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

# Characters of which we know that composing them changes nothing, and which of them are letters, digits and blanks.
_LETTER = "a-zÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{_LETTER}×÷–—‘-”…]*")
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^ \\t\\n\\r{_LETTER}0-9]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class PreTokens:
    """Pre-tokens of texts by the library's own normalizer and pre-tokenizer.

    Files set up as ``_SHORT`` have a shorter way for plain Latin text; theirs are slices of the normalized text. Those of
    any other file are what its pre-tokenizer hands to the model.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        self.short = all(setup.get(part) == setting for part, setting in _SHORT.items())
        added = self.tokenizer.get_added_tokens_decoder().values()
        odd = [t.content for t in added if t.normalized or t.single_word or t.lstrip or t.rstrip]
        if odd:
            raise ValueError(f"added tokens that are not matched as they stand: {odd}")
        special = [t.content for t in added]
        self.remembered = lru_cache(maxsize=1 << 16)(self.pieces)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _of(self, text: str) -> list[str]:
        if self.short and _PLAIN.fullmatch(text):
            return _PRETOKEN.findall(text.lower())
        normalizer, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        normal = normalizer.normalize_str(text) if normalizer else text
        if cut is None:
            return [normal] if normal else []
        found = cut.pre_tokenize_str(normal)
        return [normal[start:end] if self.short else piece for piece, (start, end) in found]

    def __call__(self, text: str) -> tuple[Counter, int]:
        """(how often it has which pre-token, how many special strings stand between)."""
        if self.special is None or not self.special.search(text):
            return Counter(self._of(text)), 0
        parts = self.special.split(text)
        found: Counter = Counter()
        for part in parts:
            found.update(self._of(part))
        return found, len(parts) - 1

    def pieces(self, pretoken: str) -> int:
        """How many tokens a pre-token becomes."""
        model = self.tokenizer.model
        if not self.short:
            return len(model.tokenize(pretoken))
        return sum(len(model.tokenize(part)) for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(pretoken))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        found, special = self(text)
        return special + sum(n * self.remembered(pretoken) for pretoken, n in found.items())


_ZSTD = pa.Codec("zstd", compression_level=1)
#: Counted pre-tokens that a task gathers before it packs them by block.
GATHERED = 1 << 20


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, compressed: their bytes by place, so that the empty upper ones take no room."""
    flat = np.ascontiguousarray(values, np.int32)
    return len(flat).to_bytes(4, "little") + _ZSTD.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    flat = np.frombuffer(_ZSTD.decompress(packed[4:], 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, n).T).view(np.int32).ravel()


_DOCS = pa.schema([("doc_id", pa.string()), ("n_bytes", pa.int64()), ("counted", pa.int64()), ("ends", pa.int64())])
_BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("places", pa.binary()), ("times", pa.binary()), ("pretokens", pa.list_(pa.string()))])
_BLOCK_SQL = "block long, docs binary, places binary, times binary, pretokens array<string>"


def _written(docs: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as out:
        out.write_batch(docs)
    return sink.getvalue().to_pybytes()


def _blocks(path: str):
    """One row for each block of documents; but for its pre-tokens it is compressed, since it is held whole where it is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = PreTokens(path)
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(steps(batches, limit=BLOCK_BYTES)):
            texts = batch.column(1)
            places: dict[str, int] = {}
            counted, ends, at, times, end = [], [], [], [], 0
            for text in texts:
                found, special = pretokens(text.as_py() or "")
                counted.append(special)
                end += len(found)
                ends.append(end)
                own = np.fromiter((places.setdefault(w, len(places)) for w in found), np.int32, len(found))
                order = np.argsort(own)
                at.append(np.diff(own[order], prepend=np.int32(0)))  # small numbers, which compress well
                times.append(np.fromiter(found.values(), np.int32, len(found))[order])
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            docs = pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counted, pa.int64()), pa.array(ends, pa.int64())], schema=_DOCS)
            row = [first + number, _written(docs), _packed(np.concatenate(at)), _packed(np.concatenate(times)), list(places)]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)

    return run


def _by_block(blocks: np.ndarray, places: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
    """A row a block: its places in order, as differences, and the pieces at them."""
    order = np.lexsort((places, blocks))
    blocks, places, pieces = blocks[order], places[order], pieces[order]
    begins = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
    cut = list(zip(begins, [*begins[1:], len(blocks)], strict=True))
    packed = [_packed(np.concatenate([np.diff(places[i:j], prepend=np.int32(0)), pieces[i:j]])) for i, j in cut]
    return pa.RecordBatch.from_arrays([pa.array(blocks[begins]), pa.array(packed, pa.binary())], names=["block", "pieces"])


def _counted(path: str):
    """Pieces of sorted pre-tokens: equal ones follow one another and are tokenized once. They go back packed, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = PreTokens(path)
        last, count = None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            counts = np.empty(batch.num_rows, np.int32)
            for i, pretoken in enumerate(batch.column(2)):
                if (pretoken := pretoken.as_py()) != last:
                    last, count = pretoken, pretokens.pieces(pretoken)
                counts[i] = count
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), counts))
            if sum(len(x) for x, _, _ in held) >= GATHERED:
                yield _by_block(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if sum(len(x) for x, _, _ in held):
            yield _by_block(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum frequency times pieces for each document of a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs, places, times, parts = (batch.column(n)[i].as_py() for n in range(4))
            docs = pa.ipc.open_stream(docs).read_next_batch()
            parts = [_unpacked(part) for part in parts]
            by_place = np.zeros(sum(map(len, parts)) // 2, np.int64)
            for part in parts:
                n = len(part) // 2
                by_place[np.cumsum(part[:n])] = part[n:]
            places, times, ends = _unpacked(places), _unpacked(times), docs.column(3).to_numpy()
            begins = np.concatenate([[0], ends[:-1]])
            upto = np.concatenate([[0], np.cumsum(places, dtype=np.int64)])
            at = upto[1:] - np.repeat(upto[begins], ends - begins)
            sums = np.zeros(len(places) + 1, np.int64)
            np.cumsum(by_place[at] * times, out=sums[1:])
            n = sums[ends] - sums[begins] + docs.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row for each row of ``docs``, as the tokenizer file at ``path`` counts.

    Any file of the library will do whose pre-tokens are tokenized one by one; one with added strings that take in their
    surroundings is refused. Special strings inside a text are one token each, as the library has it by default; none is
    added. A null text is empty and has no token; a very long one is read whole, as a block of its own. Repeated rows are counted alike, a null id stays null; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    blocks = stored(rows.mapInArrow(_blocks(path), _BLOCK_SQL), "token-blocks")
    found = blocks.select("block", F.posexplode("pretokens").alias("place", "pretoken"))
    met = found.repartition("pretoken").sortWithinPartitions("pretoken").mapInArrow(_counted(path), "block long, pieces binary")
    by_block = met.groupBy("block").agg(F.collect_list("pieces").alias("pieces"))
    joined = blocks.drop("pretokens").join(by_block, "block", "left").withColumn("pieces", F.coalesce("pieces", F.array().cast("array<binary>")))
    counted = joined.select("docs", "places", "times", "pieces").mapInArrow(_summed, "doc_id string, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
