"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions, words and what stands between them, and labels every position;
a document's probability of a language is the mean over all positions of its letters. A text is read in stretches of
``SPAN`` bytes: a stretch begins ``OVERLAP`` bytes before the first and ends as many after the last position that is
labelled from it, so that each position has been led up to from both sides. It is trained in numpy by backpropagation
through time, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanline.llm.text import fold_of, raw_bytes, steps

#: Labelled texts that are fitted on, in all (about, by hash, in equal parts by language), the length in characters up to
#: which a text can be one of them, and the stretches drawn from them and their bytes.
SAMPLE = 1600
SAMPLE_CHARS = 20_000
FIT_STRETCHES = 4000
FIT_SPAN = 96
#: Bytes of a stretch that is read, and how many of them at an inner end only lead up to the labelled ones.
SPAN = 512
OVERLAP = 32
#: Stretches that are read side by side.
ROWS = 512
HIDDEN = 12
UNKNOWN = "und"

#: Bytes of letters: ASCII letters and all bytes of code points beyond.
LETTER = np.array([chr(i).isalpha() or i > 127 for i in range(128)] + [True] * 128)


@dataclass
class Model:
    """Names of the languages; per direction the weights of bytes, of the state and of the gates; the output layer."""

    names: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray


def new_model(names: list[str], hidden: int = HIDDEN, seed: int = 3, kind: type = np.float32) -> Model:
    draw = np.random.default_rng(seed)
    inputs = [draw.normal(0, 0.3, (256, 3 * hidden)).astype(kind) for _ in range(2)]
    states = [draw.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(kind) for _ in range(2)]
    return Model(names, inputs, states, draw.normal(0, 0.3, (2 * hidden, len(names))).astype(kind), np.zeros(len(names), kind))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _read(x: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each byte of the runs (n, length) in one direction, and what the way back needs."""
    n, length = x.shape
    size = u.shape[0]
    h = np.zeros((n, size), w.dtype)
    states, kept = np.empty((length, n, size), w.dtype), []
    for t in range(length):
        from_byte, from_state = w[x[:, t]], h @ u
        gates = _sigmoid(from_byte[:, : 2 * size] + from_state[:, : 2 * size])
        z, r = gates[:, :size], gates[:, size:]
        c = np.tanh(from_byte[:, 2 * size :] + r * from_state[:, 2 * size :])
        kept.append((h, z, r, c, from_state[:, 2 * size :]))
        h = z * h + (1 - z) * c
        states[t] = h
    return states, kept


def _states(x: np.ndarray, w: np.ndarray, u: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """The states of ``_read`` alone, in place: the three gates apart, each in memory of its own.

    Where ``live`` (n, length) is 0 the state stays empty: bytes that only fill up a shorter stretch are not read.
    """
    n, length = x.shape
    size = u.shape[0]
    scale = (0.5, 0.5, 1.0)  # a sigmoid is a tanh of half
    inputs = [np.ascontiguousarray(w[:, k * size : (k + 1) * size] * scale[k]) for k in range(3)]
    weights = [np.ascontiguousarray(u[:, k * size : (k + 1) * size] * scale[k]) for k in range(3)]
    columns = np.ascontiguousarray(x.T).astype(np.intp)
    states = np.empty((length, n, size), w.dtype)
    h = np.zeros((n, size), w.dtype)
    z, r, c, part = (np.empty_like(h) for _ in range(4))
    for t in range(length):
        for k, gate in enumerate((z, r)):
            np.take(inputs[k], columns[t], 0, gate, "clip")
            gate += np.matmul(h, weights[k], part)
            np.tanh(gate, gate)
            gate *= 0.5
            gate += 0.5
        np.take(inputs[2], columns[t], 0, c, "clip")
        r *= np.matmul(h, weights[2], part)
        c += r
        np.tanh(c, c)
        h = np.subtract(h, c, states[t])
        h *= z
        h += c
        if live is not None:
            h *= live[:, t, None]
    return states


def _read_back(x: np.ndarray, u: np.ndarray, kept: list, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of byte and state weights from those of all states."""
    size = u.shape[0]
    dw, du = np.zeros((256, 3 * size), u.dtype), np.zeros_like(u)
    dh = np.zeros_like(slopes[0])
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, c, state = kept[t]
        dh = dh + slopes[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * state * r * (1 - r)
        by_byte = np.concatenate([dz, dr, dc], axis=1)
        by_state = np.concatenate([dz, dr, dc * r], axis=1)
        np.add.at(dw, x[:, t], by_byte)
        du += h.T @ by_state
        dh = dh * z + by_state @ u.T
    return dw, du


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=2, keepdims=True)
    np.exp(scores, scores)
    scores /= scores.sum(axis=2, keepdims=True)
    return scores


def labels_of(model: Model, x: np.ndarray, sizes: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
    """Probabilities (length, n, languages) of each position of stretches (n, length) of which ``sizes`` bytes are read.

    Only positions of [low, high) are labelled: reading ahead ends at the last of them, reading back at the first.
    """
    length, size = x.shape[1], model.states[0].shape[0]
    high = length if high is None else high
    live = None if sizes.min() == length else (np.arange(length) < sizes[:, None])[:, ::-1][:, : length - low]
    ahead = _states(x[:, :high], model.inputs[0], model.states[0], None)[low:]
    behind = _states(x[:, low:][:, ::-1], model.inputs[1], model.states[1], live)[::-1][: high - low]
    scores = np.zeros((length, len(x), len(model.names)), model.output.dtype)
    wanted = ahead @ model.output[:size]
    wanted += behind @ model.output[size:]
    wanted += model.bias
    scores[low:high] = _softmax(wanted)
    return scores


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of all positions and its gradients: inputs, states (each of two directions), output, bias."""
    ahead, kept_a = _read(x, model.inputs[0], model.states[0])
    behind, kept_b = _read(x[:, ::-1], model.inputs[1], model.states[1])
    both = np.concatenate([ahead, behind[::-1]], axis=2)
    p = _softmax(both @ model.output + model.bias)
    length, n, _ = p.shape
    loss = -float(np.log(np.maximum(p[:, np.arange(n), y], 1e-12)).mean())
    d = p.copy()
    d[:, np.arange(n), y] -= 1
    d /= length * n
    flat = both.reshape(-1, both.shape[2])
    slopes = d @ model.output.T
    size = model.states[0].shape[0]
    dw_a, du_a = _read_back(x, model.states[0], kept_a, slopes[:, :, :size])
    dw_b, du_b = _read_back(x[:, ::-1], model.states[1], kept_b, slopes[::-1, :, size:])
    return loss, [dw_a, dw_b, du_a, du_b, flat.T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))]


def fit(texts: list[str], langs: list[str], passes: int = 8, batch: int = 128) -> Model | None:
    """A network trained by Adam on stretches of the texts that hold a letter, as many from each language."""
    names = sorted(set(langs))
    draw = np.random.default_rng(11)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for number, name in enumerate(names):
        raw = [(text or "").encode("utf-8", "replace") for text, lang in zip(texts, langs, strict=True) if lang == name]
        places = [(r, i) for r in raw for i in range(0, max(len(r) - FIT_SPAN, 0) + 1, FIT_SPAN)]
        for k in draw.permutation(len(places))[: max(FIT_STRETCHES // len(names), 1)]:
            piece = places[k][0][places[k][1] : places[k][1] + FIT_SPAN]
            if LETTER[np.frombuffer(piece, np.uint8)].any():
                by_length.setdefault(len(piece), []).append((piece, number))
    if not by_length:
        return None
    batches = []
    for length, items in sorted(by_length.items()):
        x = np.frombuffer(b"".join(p for p, _ in items), np.uint8).reshape(-1, length)
        y = np.array([k for _, k in items])
        order = draw.permutation(len(y))
        batches += [(x[order[i : i + batch]], y[order[i : i + batch]]) for i in range(0, len(y), batch)]
    model = new_model(names)
    values = [*model.inputs, *model.states, model.output, model.bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    k = 0
    for turn in range(passes):
        rate = 0.01 * (1 - turn / passes) + 0.001
        for i in draw.permutation(len(batches)):
            k += 1
            _, slopes = gradients(model, *batches[i])
            norm = np.sqrt(sum(float((s * s).sum()) for s in slopes))
            for v, s, a, b in zip(values, slopes, first, second, strict=True):
                s = s * min(1.0, 1.0 / max(norm, 1e-12))
                a += 0.1 * (s - a)
                b += 0.01 * (s * s - b)
                v -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return model


def stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, first, past) of each stretch of texts of so many bytes: every byte is in one [first, past) alone."""
    extra = np.maximum(sizes - SPAN, 0)
    counts = np.where(sizes > 0, 1 - (-extra // (SPAN - 2 * OVERLAP)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.minimum(number * (SPAN - 2 * OVERLAP), extra[text])
    first = np.where(number > 0, begin + OVERLAP, 0)
    last = number == counts[text] - 1
    past = np.where(last, sizes[text], np.roll(first, -1))
    return text, begin, first, past


def read_texts(model: Model | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language of each text and its probability; 'und' and 0 where there is no letter."""
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    data, begins = raw_bytes(texts)
    sizes = np.diff(begins)
    text, begin, first, past = stretches(sizes)
    sums, letters = np.zeros((len(texts), len(model.names))), np.zeros(len(texts))
    # stretches side by side are about as long, and labelled at about the same places
    order = np.lexsort((past - begin, first - begin, np.minimum(sizes, SPAN)[text]))
    for block in np.array_split(order, -(-len(order) // ROWS)) if len(order) else []:
        own = np.minimum(sizes[text[block]], SPAN)
        place = np.arange(own.max())
        at = begin[block, None] + place
        counted = (at >= first[block, None]) & (at < past[block, None])
        x = data[np.minimum(begins[text[block], None] + at, len(data) - 1)]
        counted &= LETTER[x]
        p = labels_of(model, x, own, int((first - begin)[block].min()), int((past - begin)[block].max()))
        np.add.at(sums, text[block], np.einsum("tnk,nt->nk", p, counted.astype(p.dtype)))
        np.add.at(letters, text[block], counted.sum(1))
    names, scores = [], []
    for i, n in enumerate(letters):
        # a byte beyond ASCII may be of a sign or numeral: only a text of such alone is looked at by code point
        spelt = n and (_ascii_letter(data[begins[i] : begins[i + 1]]) or any(map(str.isalpha, texts[i].as_py())))
        best = int(sums[i].argmax())
        names.append(model.names[best] if spelt else UNKNOWN)
        scores.append(float(min(1.0, sums[i, best] / n)) if spelt else 0.0)
    return names, scores


def _ascii_letter(data: np.ndarray) -> bool:
    start, step = 0, 256  # nearly always among the first bytes
    while start < len(data):
        part = data[start : start + step]
        if (LETTER[part] & (part < 128)).any():
            return True
        start, step = start + step, 2 * step
    return False


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A network from the rows whose fold is not 0 and whose ``lang`` is not null; None if they have no letter.

    Fitted on about SAMPLE distinct texts of at most SAMPLE_CHARS characters, in equal parts by language: of each
    language those whose hash lies in a share of its range, all if there are fewer. Texts are counted and filtered
    where they are; none are put in order. With more than SAMPLE languages some are not learned.
    """
    body, name = F.col(f"`{text}`"), F.col(f"`{lang}`")
    usable = docs.filter(body.isNotNull() & name.isNotNull() & (fold_of(f"`{doc_id}`") != 0) & (F.length(body) <= SAMPLE_CHARS))
    usable = usable.select(name.cast("string").alias("lang"), body.alias("text"), F.xxhash64(body).alias("hash"))
    keys = usable.select("lang", "hash").distinct()
    counts = keys.groupBy("lang").agg(F.count("*").alias("n"))
    languages = max(counts.count(), 1)
    share = F.lit(SAMPLE / languages) / F.col("n")
    chosen = (
        keys.join(counts, "lang")
        .filter((share >= 1) | (F.shiftrightunsigned("hash", 1) < share * 2.0**63))
        .select("lang", "hash")
    )
    sample = (
        usable.join(F.broadcast(chosen), ["lang", "hash"], "left_semi")  # about SAMPLE rows
        .groupBy("lang", "hash")
        .agg(F.min("text").alias("text"))  # repeated rows once
        .toPandas()
        .sort_values(["lang", "hash"])
    )
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def with_language(docs: DataFrame, model: Model | None, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score); 'und' and 0 for texts that are null or have no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            langs, scores = [], []
            for part in steps(iter([pa.record_batch([array], names=["text"])])):
                found, values = read_texts(shared.value, part.column(0))
                langs += found
                scores += values
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return docs.withColumn(name, language(F.col(f"`{text}`")))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a row for each row of ``docs``, from its text alone.

    ``held_out`` rows (crc32 of the id modulo 5 is 0) are never fitted on. A text that is null or has no letter is
    'und' with score 0, as all are without any labelled row. Repeated rows are labelled alike.
    """
    model = train(docs, doc_id, text, lang)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_language(own, model).select(
        "doc_id", (fold_of() == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
