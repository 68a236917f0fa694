from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanline.llm.mixing import _leaves, mix, mix_summary, mixed, plan_mix, repeating, sized, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, share=1.5, ceiling=2.0):
    """Targets by rounds of resharing."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > ceiling * sizes[i]}
        if not over:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = ceiling * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def test_targets():
    draw = random.Random(1)
    for _ in range(200):
        n = draw.randrange(1, 12)
        sizes, weights = [draw.choice([0, 3, 50, 1000]) for _ in range(n)], [draw.choice([1, 2, 3]) for _ in range(n)]
        assert targets(sizes, weights, 1.5, 2.0) == pytest.approx(filled(sizes, weights))


def fixture():
    draw = random.Random(7)
    rows = []
    for i in range(400):
        source = draw.choice(["a", "a", "a", "b", "Z", "é", None, "", "tiny", "hot"] + ["hot"] * 8)
        words = 1 if source == "tiny" else draw.choice([0, 1, 5, 40, 300])
        rows.append((i, "\n".join(f"w{draw.randrange(99)}" for _ in range(words)), source))
    rows += [(900, None, "a"), (901, None, "empty"), (902, " \t", "empty"), (903, "x " * 100000, "hot"), (None, "no id here", "b")]
    return rows + [rows[5], rows[5], (5, "other text", "b")]


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, size string").repartition(3)


def test_contract(spark):
    rows = fixture()
    got = mix_summary(frame_of(spark, rows)).collect()
    sizes = {(d, t): len(WORD.findall(t or "")) for d, t, _ in rows}
    by_source = Counter()
    for d, t, s in rows:
        by_source[s] += sizes[d, t]
    names = sorted((s for s in by_source if s is not None)) + [None]
    want = dict(zip(names, filled([by_source[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, sizes[d, t]) for d, t, _ in rows)
    taken = Counter()
    source_of = {(d, sizes[d, t]): s for d, t, s in rows}
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == by_source[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 3  # repeated rows share the last words evenly
    assert sorted(map(str, got)) == sorted(map(str, mix_summary(frame_of(spark, rows)).collect()))


def test_quotas_and_shards(spark):
    rows = sized(frame_of(spark, fixture()))
    plan = plan_mix(rows, repeating(), shard_words=20_000)
    assert plan.shards > 5
    draws = plan.draws.collect()
    assert len(draws) == plan.n_draws == len({(r["__source"], r["pass"], r["block"]) for r in draws})
    per_shard = Counter(r.shard for r in draws)
    assert max(per_shard.values()) - min(per_shard.values()) <= math.log2(plan.shards) + 1
    by_source = defaultdict(Counter)
    for r in draws:
        by_source[r["__source"]][r.shard] += 1
    hot = by_source["shot"]
    mean = sum(hot.values()) / plan.shards
    assert all(abs(hot[k] - mean) < 6 * math.sqrt(mean) for k in range(plan.shards))
    copies = mixed(rows, plan)
    assert copies.groupBy("n", "pass").count().filter("count > 1").count() == 0


def test_tree_is_exact():
    import pandas as pd

    quotas = np.array([1000, 3, 77, 500], np.int64)
    parts = list(_leaves(7, quotas, list("abcd"))(iter([pd.DataFrame({"shard": range(7)})])))
    total = sum(p["quota"].to_numpy() for p in parts)
    assert total.tolist() == quotas.tolist() and {int(p["quota"].sum()) for p in parts} <= {225, 226}


def test_plan_in_tables_beyond_the_bound(spark):
    rows = sized(frame_of(spark, fixture()))
    columns = ["__source", "source_size", "target", "passes", "rest", "cut", "part"]
    for weigh in (repeating(), lambda names: [(3, 1, 2)[i % 3] for i in range(len(names))]):
        for share in (1.5, 0.3, 9.0):
            held, tables = (plan_mix(rows, weigh, share, shard_words=20_000, max_sources=m) for m in (10_000, 3))
            assert held.few and not tables.few and held.shards == tables.shards
            one, other = (sorted(tuple(r) for r in p.sources.select(columns).collect()) for p in (held, tables))
            assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in other]
            assert [r[2] for r in one] == pytest.approx([r[2] for r in other])
    held, tables = (plan_mix(rows, repeating(), shard_words=20_000, max_sources=m) for m in (10_000, 3))
    taken = ["n", "pass", "words"]
    one, other = (sorted(tuple(r) for r in mixed(rows, p).select(taken).collect()) for p in (held, tables))
    assert one == other
    draws = tables.draws.collect()
    assert len(draws) == tables.n_draws == len({(r["__source"], r["pass"], r["block"]) for r in draws})
    per_shard = Counter(r.shard for r in draws)
    assert len(per_shard) == tables.shards and max(per_shard.values()) - min(per_shard.values()) <= math.log2(tables.shards) + 1


def test_more_sources_than_the_bound(spark):
    docs = spark.range(10_500).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 AS int)) AS text", "concat('site', id % 10100) AS source")
    got = mix_summary(docs).collect()
    assert len(got) == 10_500
    words, want, taken = Counter(), {}, Counter()
    for r in got:
        name = f"site{r.doc_id % 10_100}"
        words[name] += r.size
        taken[name] += r.taken
        want[name] = r.target
    names = sorted(words)
    assert [want[n] for n in names] == pytest.approx(targets([words[n] for n in names], repeating()(names), 1.5, 2.0))
    assert all(taken[n] == math.floor(want[n] + 0.5) for n in names)


def test_rows_of_the_mix(spark):
    rows = fixture()[:405]
    frame = frame_of(spark, rows)
    out = mix(frame)
    assert out.columns == [*frame.columns, "mix_shard", "mix_place", "mix_pass", "mix_words"]
    got = out.collect()
    assert all(len(WORD.findall(r.text)) == r.mix_words for r in got)
    summary = {r.doc_id: r.taken for r in mix_summary(frame).collect()}
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.mix_words
    assert {k: v for k, v in summary.items() if v} == dict(taken)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_summary(none).count() == 0 and mix(none).count() == 0
    bare = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_summary(bare).orderBy("doc_id").collect()] == [(0, 0.0, 0)] * 2
    assert mix(bare).count() == 0
