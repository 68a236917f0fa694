from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanline.llm import language
from loanline.llm.language import OVERLAP, SPAN, fit, gradients, identify, new_model, read_texts, stretches


def test_gradients_against_differences():
    model = new_model(["a", "b", "c"], hidden=3, kind=np.float64)
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 5, (4, 6)).astype(np.uint8), draw.integers(0, 3, 4)
    _, slopes = gradients(model, x, y)
    for value, slope in zip([*model.inputs, *model.states, model.output, model.bias], slopes, strict=True):
        flat, found = value.reshape(-1), slope.reshape(-1)
        for i in np.unique(draw.integers(0, min(len(flat), 45), 12)):
            kept = flat[i]
            flat[i] = kept + 1e-5
            up, _ = gradients(model, x, y)
            flat[i] = kept - 1e-5
            down, _ = gradients(model, x, y)
            flat[i] = kept
            assert found[i] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def plain_states(model, way, raw):
    """States after each byte, one number at a time."""
    w, u = model.inputs[way].tolist(), model.states[way].tolist()
    size = len(u)
    h, out = [0.0] * size, []
    for byte in raw:
        state = [sum(h[i] * u[i][k] for i in range(size)) for k in range(3 * size)]
        z = [1 / (1 + math.exp(-w[byte][k] - state[k])) for k in range(size)]
        r = [1 / (1 + math.exp(-w[byte][size + k] - state[size + k])) for k in range(size)]
        c = [math.tanh(w[byte][2 * size + k] + r[k] * state[2 * size + k]) for k in range(size)]
        h = [z[k] * h[k] + (1 - z[k]) * c[k] for k in range(size)]
        out.append(h)
    return out


def plain_label(model, text):
    """Mean label of the bytes of letters, each from the stretch that it lies deepest in."""
    raw, sums, letters = text.encode(), [0.0] * len(model.names), 0
    begins = [0]
    while begins[-1] + SPAN < len(raw):
        begins.append(min(begins[-1] + SPAN - 2 * OVERLAP, len(raw) - SPAN))
    for number, begin in enumerate(begins):
        part = raw[begin : begin + SPAN]
        ahead, behind = plain_states(model, 0, part), plain_states(model, 1, part[::-1])[::-1]
        low = begin + OVERLAP if number else 0
        high = begins[number + 1] + OVERLAP if number + 1 < len(begins) else len(raw)
        for at in range(low, high):
            byte = raw[at]
            if byte < 128 and not chr(byte).isalpha():
                continue
            both = ahead[at - begin] + behind[at - begin]
            scores = [sum(b * model.output[i, k] for i, b in enumerate(both)) + model.bias[k] for k in range(len(sums))]
            total = sum(map(math.exp, scores))
            sums = [x + math.exp(y) / total for x, y in zip(sums, scores, strict=True)]
            letters += 1
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    best = max(range(len(sums)), key=sums.__getitem__)
    return model.names[best], sums[best] / letters


TEXTS = ["the thing is here", "das Ding ist hier und da", "x", "1 2 3", "", "\u00bd \u2167", "\u4e2d", "Donaudampfschifffahrtsgesellschaftskapit\u00e4n ist da"]


def test_labels_against_a_plain_network():
    model = new_model(["a", "b", "c"], hidden=3, kind=np.float64)
    draw = random.Random(2)
    texts = TEXTS + ["".join(draw.choice("ab \u00e91\n\u4e2d") for _ in range(n)) for n in (90, 254, 255, 256, 257, 700, 1500)]
    names, scores = read_texts(model, pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        assert (name, pytest.approx(score, abs=1e-9)) == plain_label(model, text)


def test_each_byte_is_labelled_once():
    sizes = np.array([0, 1, SPAN, SPAN + 1, 0, 5 * SPAN, 1000, SPAN - 1])
    text, begin, first, past = stretches(sizes)
    for i, size in enumerate(sizes):
        own = text == i
        assert sorted(b for a, z in zip(first[own], past[own], strict=True) for b in range(a, z)) == list(range(size))
        assert all(b <= f and p <= b + SPAN for b, f, p in zip(begin[own], first[own], past[own], strict=True))


def test_labels_do_not_depend_on_what_is_read_beside():
    texts = TEXTS * 3 + ["das Ding " * 200, None]
    model = fit(["the thing is here and that", "das Ding ist hier und da"] * 9, ["en", "de"] * 9, passes=2)
    together = read_texts(model, pa.array(texts))
    for i, text in enumerate(texts):
        name, score = read_texts(model, pa.array([text], pa.string()))
        assert together[0][i] == name[0] and together[1][i] == pytest.approx(score[0], abs=1e-5)
    assert together[0][3:6] == ["und"] * 3 and together[1][3:6] == [0.0] * 3 and together[0][-1] == "und"


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(90001, None, "en"), (90002, "", "en"), (90003, "123 !!", "de"), (90005, "\u00bd \u2167 \u00b2", None), (None, "the thing of that", None), (90004, "the and " * 100000, None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(more).withColumn("score", F.lit("clash"))
    rows = identify(both).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (90001, 90002, 90003, 90005)] == ["und"] * 4 and by_id[90004].lang_pred == "en" == by_id[None].lang_pred
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    print("held-out accuracy", right, len(held))
    assert right > 0.97


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    twisted = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda r: (r.doc_id, r.lang_pred, r.score)
    assert sorted(map(key, identify(docs).collect())) == sorted(map(key, identify(twisted).collect()))


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(none).count() == 0
    assert identify(spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"


def test_only_labelled_places_are_read(monkeypatch):
    model = new_model(["a", "b"])
    text = "abc def " * 600
    sizes = np.array([len(text)] * 400)
    whole, read = language.labels_of, []
    before = language._states
    monkeypatch.setattr(language, "_states", lambda x, *rest: read.append(x.size) or before(x, *rest))
    found = read_texts(model, pa.array([text] * len(sizes)))
    _, begin, first, past = stretches(sizes)
    assert 2 * sizes.sum() <= sum(read) < 0.95 * 2 * SPAN * len(begin)
    monkeypatch.setattr(language, "labels_of", lambda m, x, own, low, high: whole(m, x, own))
    assert found[0] == read_texts(model, pa.array([text] * len(sizes)))[0]
    assert found[1] == pytest.approx(read_texts(model, pa.array([text] * len(sizes)))[1], abs=1e-6)
