"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and offsets.

Labels are of documents, so words are labelled first: in a toxic document, those that toxic documents have far oftener
than clean ones (a likelihood-ratio test), in a clean document none. The field is trained on these words in numpy, on a
bounded sample. Scoring cuts every whole text into runs of words and sends them through forward-backward side by side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanline.llm.text import fold_of, steps

#: Labelled rows of each class that are fitted on (all, or about so many by hash), and the length in characters up to which
#: a text can be one of them.
SAMPLE = 2000
SAMPLE_CHARS = 20_000
#: Words of a chain; runs of the sample that are fitted on.
RUN = 64
FIT_RUNS = 6000
#: Likelihood ratio from which a word of toxic documents is labelled toxic.
EVIDENCE = 14.0
FEATURE_BITS = 16
#: Distinct words whose weights a task remembers.
REMEMBERED = 500_000

WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Weights of hashed word features (for the toxic state; the other has 0), of transitions and of the document score.

    ``rates``: expected toxic words a word of clean and of toxic documents.
    """

    weights: np.ndarray
    moves: np.ndarray
    score: np.ndarray
    rates: np.ndarray


def _features(word: str) -> list[int]:
    w = word.lower()
    mask = (1 << FEATURE_BITS) - 1
    return [zlib.crc32(x.encode("utf-8", "replace")) & mask for x in ("w" + w, "p" + w[:4], "s" + w[-4:], f"n{min(len(w), 12)}")]


class _Vocabulary(dict):
    """Numbers for words, and the features of each."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.features = np.zeros((0, 4), np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def known(self) -> np.ndarray:
        if self.new:
            self.features = np.concatenate([self.features, np.array([_features(w) for w in self.new], np.int64)])
            self.new = []
        return self.features


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts of these lengths into runs: (first word, length, text) of each."""
    counts = -(-lengths // RUN)
    owner = np.repeat(np.arange(len(lengths)), counts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + index * RUN
    return starts, np.minimum(RUN, lengths[owner] - index * RUN), owner


def _chains(emissions: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward of a batch of chains, scaled: P(toxic) by place, and the expected moves 2 x 2 over all."""
    n, width = emissions.shape
    toxic = np.exp(np.clip(emissions, -30, 30))
    step = np.exp(moves)
    ahead = np.zeros((width, n, 2))
    a, b = np.full(n, step[0, 0]), toxic[:, 0] * step[0, 1]  # a chain starts as if after a clean word
    for t in range(width):
        if t:
            a, b = a * step[0, 0] + b * step[1, 0], (a * step[0, 1] + b * step[1, 1]) * toxic[:, t]
        total = a + b
        a, b = a / total, b / total
        ahead[t, :, 0], ahead[t, :, 1] = a, b
    marginals = np.zeros((n, width))
    expected = np.zeros((2, 2))
    c, d = np.ones(n), np.ones(n)
    for t in range(width - 1, -1, -1):
        x, y = ahead[t, :, 0] * c, ahead[t, :, 1] * d
        inside = t < sizes
        marginals[:, t] = np.where(inside, y / (x + y), 0.0)
        if t:
            p, q = ahead[t - 1, :, 0], ahead[t - 1, :, 1]
            e = toxic[:, t]
            pairs = np.stack([p * step[0, 0] * c, p * step[0, 1] * e * d, q * step[1, 0] * c, q * step[1, 1] * e * d])
            pairs = pairs / pairs.sum(0) * inside
            expected += pairs.sum(1).reshape(2, 2)
            c, d = (
                np.where(inside, step[0, 0] * c + step[0, 1] * e * d, 1.0),
                np.where(inside, step[1, 0] * c + step[1, 1] * e * d, 1.0),
            )
            total = c + d
            c, d = c / total, d / total
    first = marginals[:, 0].sum()
    expected[0] += [np.count_nonzero(sizes) - first, first]
    return marginals, expected


def _padded(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(RUN)
    return np.where(np.arange(RUN) < sizes[:, None], values[np.minimum(at, max(len(values) - 1, 0))], 0)


def _expected(marginals: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The expected number of toxic words of each text."""
    return np.bincount(owner, weights=marginals.sum(1), minlength=texts)


def _summary(expected: np.ndarray, lengths: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Document features: constant, and how much likelier so many toxic words in so many are at the toxic rate than at the clean one.

    Words that a clean text has by chance grow with its length, and so does what the toxic rate would have given: the
    longer a text, the more of them it takes.
    """
    clean, toxic = rates
    ratio = expected * np.log(toxic / clean) - lengths * (toxic - clean)
    return np.stack([np.ones(len(expected)), np.arcsinh(ratio)], axis=1)


def _rates(expected: np.ndarray, lengths: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Toxic words a word of either class, never 0 and never less in the toxic one."""
    clean = (expected[toxic == 0].sum() + 0.1) / (lengths[toxic == 0].sum() + 1000)
    return np.array([clean, max((expected[toxic == 1].sum() + 0.1) / (lengths[toxic == 1].sum() + 10), 2 * clean)])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _logistic(x @ w)
        gradient = x.T @ (p - y) + 0.01 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), gradient)
    return w


def _novel(texts: list[np.ndarray], toxic: np.ndarray) -> list[int]:
    """Texts of which at most half of the word triples were in earlier texts of the class: copies tell nothing new."""
    seen: tuple[set, set] = (set(), set())
    out = []
    for i, (ids, label) in enumerate(zip(texts, toxic, strict=True)):
        x = ids.astype(np.uint64)
        triples = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] if len(x) > 2 else x
        triples = triples ^ (triples >> np.uint64(29))
        if len(triples) > 64:
            triples = triples[triples % np.uint64(8) == 0]  # an eighth of them will do
        known = seen[int(label)]
        own = set(triples.tolist())
        if 2 * len(own & known) <= len(own):
            out.append(i)
        known |= own
    return out


def _toxic_words(texts: list[np.ndarray], toxic: np.ndarray, words: int) -> np.ndarray:
    """Marks words that toxic texts have oftener than clean ones, with a likelihood ratio of EVIDENCE or more."""
    counts = np.zeros((2, words))
    for ids, label in zip(texts, toxic, strict=True):
        counts[int(label), np.unique(ids)] += 1
    n0, n1 = float(np.sum(toxic == 0)), float(np.sum(toxic == 1))
    rate = counts.sum(0) / max(n0 + n1, 1)

    def part(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(count > 0, count * np.log(np.maximum(count, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    ratio = part(counts[1], n1 * rate) + part(counts[0], n0 * rate) + part(n1 - counts[1], n1 * (1 - rate)) + part(n0 - counts[0], n0 * (1 - rate))
    return (counts[1] * n0 > 4 * counts[0] * n1) & (2 * ratio >= EVIDENCE)


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 80) -> Model | None:
    """Label words, train the field by Adam on the likelihood of the labelled runs, then fit the document score.

    Copies of earlier texts are left out, so that the words of a text with many copies are no evidence.
    """
    if not len(texts):
        return None
    vocabulary = _Vocabulary()
    numbered = [np.array([vocabulary[w.lower()] for w in WORD.findall(t or "")], np.int64) for t in texts]
    chosen = _novel(numbered, toxic)
    numbered, toxic = [numbered[i] for i in chosen], toxic[chosen]
    is_seed = _toxic_words(numbered, toxic, len(vocabulary))
    lengths = np.array([len(x) for x in numbered], np.int64)
    numbers = np.concatenate(numbered)
    features = vocabulary.known()
    starts, sizes, owner = _runs(lengths)
    model = Model(np.zeros(1 << FEATURE_BITS), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    if len(numbers):
        truth = is_seed[numbers] & np.repeat(toxic.astype(np.bool_), lengths)
        has = np.add.reduceat(truth, starts) > 0
        order = np.random.default_rng(1).permutation(len(starts))
        chosen = np.concatenate([order[has[order]][: FIT_RUNS // 2], order[~has[order]][: FIT_RUNS // 2]])
        ids, labels, size = _padded(numbers, starts[chosen], sizes[chosen]), _padded(truth, starts[chosen], sizes[chosen]), sizes[chosen]
        before = np.concatenate([np.zeros((len(chosen), 1), np.int64), labels[:, :-1]], axis=1)
        inside = np.arange(RUN) < size[:, None]
        seen = np.array([[np.count_nonzero(inside & (before == i) & (labels == j)) for j in (0, 1)] for i in (0, 1)], float)
        first, second = [np.zeros_like(model.weights), np.zeros((2, 2))], [np.zeros_like(model.weights), np.zeros((2, 2))]
        count = float(inside.sum())
        for k in range(1, rounds + 1):
            emissions = model.weights[features].sum(1)[ids]
            marginals, expected = _chains(emissions, size, model.moves)
            by_word = np.bincount(ids[inside], weights=(labels - marginals)[inside], minlength=len(features))
            gradient = np.zeros_like(model.weights)
            for column in features.T:
                gradient += np.bincount(column, weights=by_word, minlength=len(gradient))
            for i, (value, slope) in enumerate(((model.weights, gradient - 0.05 * model.weights), (model.moves, seen - expected))):
                slope = slope / count
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.99 * second[i] + 0.01 * slope**2
                value += 0.3 * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-6)
        marginals, _ = _chains(_padded(model.weights[features].sum(1)[numbers], starts, sizes), sizes, model.moves)
    else:
        marginals = np.zeros((0, RUN))
    expected = _expected(marginals, owner, len(numbered))
    model.rates = _rates(expected, lengths, toxic)
    model.score = _fit_score(_summary(expected, lengths, model.rates), toxic.astype(float))
    return model


class Tagger:
    """Scores batches of whole texts; equal words share their weights."""

    def __init__(self, model: Model | None) -> None:
        self.model = model
        self.vocabulary = _Vocabulary()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """The score of each text, and its words with a marginal above one half, as code point offsets."""
        if self.model is None:
            return np.zeros(len(texts)), [[] for _ in texts]
        if len(self.vocabulary) > REMEMBERED:
            self.vocabulary = _Vocabulary()
        number = self.vocabulary.__getitem__
        lengths, numbers = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            words = WORD.findall(text or "")
            lengths[i] = len(words)
            numbers.extend(map(number, words))
        weights = self.model.weights[self.vocabulary.known()].sum(1)
        starts, sizes, owner = _runs(lengths)
        values = weights[np.array(numbers, np.int64)] if numbers else np.zeros(0)
        marginals, _ = _chains(_padded(values, starts, sizes), sizes, self.model.moves)
        expected = _expected(marginals, owner, len(texts))
        scores = _logistic(_summary(expected, lengths, self.model.rates) @ self.model.score)
        spans: list[list[dict]] = [[] for _ in texts]
        run, place = np.nonzero(marginals > 0.5)
        if len(run):
            at = starts[run] + place - (np.cumsum(lengths) - lengths)[owner[run]]
            wanted: dict[int, set] = {}
            for i, k in zip(owner[run].tolist(), at.tolist(), strict=True):
                wanted.setdefault(i, set()).add(k)
            for i, places in wanted.items():
                spans[i] = [{"start": m.start(), "end": m.end()} for k, m in enumerate(WORD.finditer(texts[i] or "")) if k in places]
        return scores, spans


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """A model from labelled rows whose fold is not 0; None if there is none.

    Fitted on all labelled ids of a class, or where there are more than SAMPLE on those whose hash lies in a share of its
    range that holds about as many (within some hundreds), as far as their texts have at most SAMPLE_CHARS characters.
    Ids are counted and then filtered where they are; no class is put in order. An id with several labels counts as toxic if one of them says so; of several texts of an
    id the least is fitted on.
    """
    marks = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold_of(doc_id) != 0))
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.max(F.col(label).cast("int")).alias("__toxic"))
        .filter("__toxic in (0, 1)")
    )
    counts = {r["__toxic"]: r["n"] for r in marks.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    place = F.shiftrightunsigned(F.xxhash64("__id"), 1)
    inside = [(F.col("__toxic") == k) & (place < int(SAMPLE / n * 2**63)) if n > SAMPLE else F.col("__toxic") == k for k, n in counts.items()]
    chosen = marks.filter(reduce(or_, inside, F.lit(False))).select("__id", "__toxic")
    body = F.col(f"`{text}`")
    sample = (
        docs.filter(body.isNotNull() & (F.length(body) <= SAMPLE_CHARS))
        .select(F.col(f"`{doc_id}`").alias("own"), body.alias("text"))
        .join(F.broadcast(chosen), F.col("own") == F.col("__id"))  # about 2 * SAMPLE rows
        .groupBy(F.col("__id").alias("id"), F.col("__toxic").alias("toxic"))
        .agg(F.min("text").alias("text"))  # however many rows have the id
        .toPandas()
        .sort_values("id")
    )
    return fit(sample["text"].tolist(), sample["toxic"].to_numpy(np.int64))


def with_toxicity(docs: DataFrame, model: Model | None, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a struct (score double, spans array of (start, end)); null and empty texts score as wordless ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, spans: array<struct<start: int, end: int>>>")
    def toxicity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(shared.value)
        kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for array in texts:
            scores, spans = [], []
            for part in steps(iter([pa.record_batch([array], names=["text"])])):
                found, where = tagger(part.column(0).to_pylist())
                scores += found.tolist()
                spans += where
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind[1].type)], fields=list(kind))

    return docs.withColumn(name, toxicity(F.col(f"`{text}`")))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): a row for each row of ``docs``.

    The model sees words alone. ``held_out`` rows (crc32 of the id modulo 5 is 0) are never fitted on. Without any
    labelled row all scores are 0. Repeated rows score alike; other columns are ignored.
    """
    model = train(docs, labels, doc_id, text)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scored = with_toxicity(own, model).select("doc_id", "toxicity")
    return scored.select(
        "doc_id",
        (fold_of() == 0).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.spans").alias("spans"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under one half, all columns as they are, whatever their names.

    Null, empty and wordless texts score alike, by the share of toxic documents; texts of any length are scored whole, and
    a long one takes toxic words in proportion; repeated rows stay or go together; without labels all rows stay.
    """
    model = train(docs, labels, doc_id, text)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return with_toxicity(own, model).filter("toxicity.score < 0.5").select("row.*")
