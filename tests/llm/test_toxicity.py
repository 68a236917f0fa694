from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanline.llm import toxicity
from loanline.llm.toxicity import Tagger, _chains, drop_toxic, fit, score_documents

BAD = ["idiot", "moron", "scum"]


def test_forward_backward_against_all_paths():
    draw = np.random.default_rng(3)
    emissions, moves = draw.normal(size=(4, 5)), draw.normal(size=(2, 2))
    sizes = np.array([5, 1, 3, 4])
    marginals, expected = _chains(emissions, sizes, moves)
    want, pairs = np.zeros((4, 5)), np.zeros((2, 2))
    for n, size in enumerate(sizes):
        paths = list(itertools.product((0, 1), repeat=size))
        weights = [math.exp(sum(emissions[n, t] * p[t] for t in range(size)) + sum(moves[a, b] for a, b in zip((0, *p), p, strict=False))) for p in paths]
        for p, w in zip(paths, weights, strict=True):
            w /= sum(weights)
            for t in range(size):
                want[n, t] += w * p[t]
            for a, b in zip((0, *p), p, strict=False):
                pairs[a, b] += w
    assert marginals == pytest.approx(want) and expected == pytest.approx(pairs)


def corpus(spark, n=600):
    draw = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{draw.integers(300)}" for _ in range(draw.integers(5, 300))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words[draw.integers(len(words))] = draw.choice(BAD)
        docs.append((i, ". ".join(words), "x"))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    docs += [(9000, None, "x"), (9001, "", "x"), (None, "you IDIOT, you", "x"), (9002, ("w1 " * 50 + "scum ") * 2000, "x"), (9003, "w1 " * 100000 + "scum", "x"), (0, docs[0][1], "x")]
    labels += [(None, 0, 1), (1, 0, None), (77777, 0, 1), labels[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores(spark):
    docs, labels = corpus(spark)
    rows = score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    toxic = {d for d, t in text if t and any(b in t.lower() for b in BAD)} - {9003}  # one such word in 100,000
    assert {r.doc_id for r in rows if r.predicted} == toxic
    assert sum(r.held_out for r in rows) == docs.filter("crc32(cast(doc_id as string)) % 5 = 0 or (doc_id is null and crc32('null') % 5 = 0)").count()
    by_id = {r.doc_id: r for r in rows}
    long = next(t for d, t in text if d == 9002)
    assert [long[s.start : s.end] for s in by_id[9002].spans] == ["scum"] * 2000 and len(by_id[9003].spans) == 1
    assert [(s.start, s.end) for s in by_id[None].spans] == [(4, 9)]


def test_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    twisted = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda r: (str(r.doc_id), r.score)
    assert sorted(map(key, score_documents(docs, labels).collect())) == sorted(map(key, score_documents(docs, twisted).collect()))


def test_scores_do_not_depend_on_the_batch():
    texts = [f"w{i % 7} " * (i % 150) + ("idiot" if i % 5 == 0 else "") for i in range(100)]
    model = fit(texts, np.array([i % 5 == 0 for i in range(100)], np.int64))
    together, _ = Tagger(model)(texts)
    alone = [Tagger(model)([t])[0][0] for t in texts]
    assert together == pytest.approx(alone) and [x > 0.5 for x in together] == [i % 5 == 0 for i in range(100)]


def test_dropping_and_no_labels(spark):
    docs, labels = corpus(spark, 300)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.filter("lower(text) rlike 'idiot|moron|scum'").collect()] == [9003]
    assert kept.count() == docs.count() - docs.filter("lower(text) rlike 'idiot|moron|scum'").count() + 1
    none = labels.limit(0)
    assert drop_toxic(docs, none).count() == docs.count() and score_documents(docs.limit(0), labels).count() == 0


def test_long_and_clean_texts_of_every_length(spark):
    """Over all labelled documents, and clean texts joined to very long ones."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_documents(docs, labels).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id").collect()
    for low, high in ((0, 1000), (1000, 4000), (4000, 10_000), (10_000, 20_000), (20_000, 1 << 31)):
        band = [r for r in rows if low <= len(r.text or "") < high and r.toxic == 0]
        assert sum(r.predicted for r in band) <= 0.03 * len(band), (low, len(band))
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    found = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    assert right > 0.98 and found > 0.9
    model, clean = toxicity.train(docs, labels), " ".join(r.text for r in rows if r.toxic == 0 and r.score < 0.3).split()
    for n in (50_000, 200_000, 1_000_000):
        words = (clean * (1 + n // len(clean)))[:n]
        assert Tagger(model)([" ".join(words)])[0][0] < 0.1


def test_sample_by_share_of_the_hashes(spark, monkeypatch):
    docs, labels = corpus(spark)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(len(texts)))
    for sample in (2000, 100, 1):
        monkeypatch.setattr(toxicity, "SAMPLE", sample)
        toxicity.train(docs, labels)
    assert seen[0] > 300 and 100 < seen[1] < 200 and seen[2] < 12


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_documents(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    found = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    print("accuracy", right, "recall", found, len(rows), toxicity.EVIDENCE)
    assert right > 0.95 and found > 0.8
