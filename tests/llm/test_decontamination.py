from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from loanline.llm.decontamination import contamination, drop_contaminated, winnowed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        if w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        names = sorted(str(i) for i in items if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture(vocabulary=40):
    draw = random.Random(8)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["Él", "ß9", "Z"]

    def text(n):
        return " ".join(draw.choice(vocab) for _ in range(n))

    lengths = [0, 1, 2, 6, 7, 8, 12, 13, 14, 20, 45]
    bench = [(i, text(lengths[i % len(lengths)] if vocabulary > 100 else max(5, lengths[i % len(lengths)]))) for i in range(33)]
    bench += [(100, bench[20][1]), (101, bench[20][1]), (None, bench[9][1]), (102, None), (103, "..."), (100, bench[20][1]), (104, "same " * 30)]
    docs = []
    for i in range(80):
        parts = [text(draw.randrange(30))]
        for _ in range(draw.randrange(3)):
            w = words(draw.choice(bench)[1])
            cut = draw.randrange(0, 3)
            parts += [" ".join(w[cut:]).upper().replace(" ", "\n-"), text(draw.randrange(60))]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "!!"), (None, bench[10][1]), (5, docs[5][1]), (5, "another " + bench[10][1]), (203, "same " * 5000), (204, text(40000))]
    return docs, bench


def rows(frame):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_against_brute_force(spark):
    for vocabulary in (40, 4000):
        docs, bench = fixture(vocabulary)
        d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, print string").repartition(3)
        b = spark.createDataFrame([(*x, "c") for x in bench], "item_id long, text string, items string")
        assert rows(contamination(d, b)) == brute(docs, bench)


def test_empty_tables(spark):
    docs, bench = fixture(4000)
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(contamination(d, none_b)) == brute(docs, [])
    assert contamination(none_d, spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_dropping(spark):
    docs, bench = fixture(4000)
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, row string")
    kept = drop_contaminated(d, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in brute(docs, bench) if not x[5])


def test_shared_spans_share_a_fingerprint():
    draw = np.random.default_rng(2)
    for _ in range(200):
        shared = draw.integers(0, 5, 13).astype(np.uint64)
        prints = []
        for _ in range(2):
            ahead = draw.integers(0, 5, draw.integers(0, 30)).astype(np.uint64)
            all_words = np.concatenate([ahead, shared, draw.integers(0, 5, 20).astype(np.uint64)])
            at, found, _ = winnowed(all_words, np.zeros(len(all_words), np.int64), 13)
            prints.append({(int(p), int(a) - len(ahead)) for a, p in zip(at, found, strict=True) if 0 <= a - len(ahead) <= 6})
        assert prints[0] & prints[1]


def test_shared_phrases_shorter_than_a_window_join_nothing(spark, monkeypatch):
    """A phrase of 12 words in 1,000 documents and 1,000 items, and a window that 300 of each share."""
    import loanline.llm.decontamination as module

    seen = []
    monkeypatch.setattr(module, "stored", lambda df, name, keep=module.stored: seen.append((name, keep(df, name))) or seen[-1][1])
    phrase = " ".join(f"t{i}" for i in range(12))
    docs = [(i, f"d{i} x{i} {phrase} y{i} " + " ".join(f"z{i}q{j}" for j in range(30)) + (f" {phrase} whole" if i < 300 else "")) for i in range(1000)]
    items = [(i, f"a{i} b{i} {phrase} {'whole' if i < 300 else f'c{i}'} e{i} f{i}") for i in range(1000)]
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r.doc_id: r for r in found.collect()}
    assert {r.n_hit for d, r in rows.items() if d < 300} == {13} and {r.n_items for d, r in rows.items() if d < 300} == {300}
    assert all(r.n_hit == r.n_items == 0 for d, r in rows.items() if d >= 300)
    marked = next(df for name, df in seen if name == "document-windows")
    windows = next(df for name, df in seen if name == "benchmark-windows")
    joined = marked.selectExpr("explode(found) AS f").select("f.*").join(windows, ["span", "whole"])
    assert joined.count() < 10_000 and windows.count() < 10_000
