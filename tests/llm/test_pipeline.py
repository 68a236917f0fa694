"""Each stage of the pipeline, on its own input, against a plain version."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loanline.llm import toxicity
from loanline.llm.mixing import targets
from tests.llm import test_decontamination, test_lines, test_simhash

FOLDER = "/root/testdata/sf0.001"
WORD = test_lines.WORD


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    # copies, and a passage that several documents have
    extra = docs.limit(1).selectExpr("explode(sequence(100001, 100004)) AS doc_id", "concat(text, '\\n', repeat('passage words here ', 20), if(doc_id % 2 = 0, 'x', 'x')) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra.selectExpr("cast(doc_id AS long) doc_id", "text", "lang", "source", "n_chars"))
    tagger = toxicity.Tagger(toxicity.train(docs, labels))
    before = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text) for r in before.collect()]
        stage(spark, before, FOLDER).write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        got = sorted(((r.doc_id, r.text) for r in after.collect()), key=str)
        if number < 4:
            assert after.columns == docs.columns
        if name == "toxicity":
            scores, _ = tagger([t for _, t in rows])
            want = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
        elif name == "line dedup":
            want = [(d, t) for d, _, n, t in test_lines.brute(rows) if not n or WORD.search(t)]
        elif name == "near-dedup":
            kept = {d for d, _, c in test_simhash.brute(rows) if d == c}
            want = [r for r in rows if r[0] in kept]
        elif name == "decontamination":
            kept = {r[0] for r in test_decontamination.brute(rows, bench) if not r[5]}
            want = [r for r in rows if r[0] in kept]
        else:
            size = Counter()
            for r in before.collect():
                size[r.source] += len(WORD.findall(r.text or ""))
            names = sorted(size)
            wanted = targets([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)
            taken = Counter()
            for r in after.collect():
                taken[r.source] += r.mix_words
                assert len(WORD.findall(r.text)) == r.mix_words
            assert all(abs(taken[n] - w) <= 1 for n, w in zip(names, wanted, strict=True))
            break
        assert got == sorted(want, key=str), name
        before = after


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0 and len(corpus_pipeline.STAGES) == 5


_CLASHING = ["__row", "__first", "__head", "__found", "__of", "__removed", "__lines", "__numbers", "__differing", "__dirty", "__toxicity"]
_CLASHING += ["__id", "__doc", "__source", "__size", "__key", "row", "toxicity", "c0", "c1", "shard", "words", "place", "mix_shard", "mix_words", "text2"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, name):
    """Each stage, with a column of every name that one uses inside, gives what it gives without them."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    more = docs.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in _CLASHING])
    plain, got = stage(spark, docs, folder), stage(spark, more, folder)
    mixed = ["mix_shard", "mix_place", "mix_pass", "mix_words"] if name == "mixing" else []
    kept = [c for c in _CLASHING if c not in mixed]
    assert got.columns == [*docs.columns, *kept, *mixed]
    rows = got.collect()
    assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in kept)
    key = lambda r: tuple(str(r[c]) for c in plain.columns)
    assert sorted(map(key, rows)) == sorted(map(key, plain.collect()))
