from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loanline.llm.spelling import _near_in_list, group_variants, near_words, vocabulary


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows, misspell):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % misspell == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return words


def plain(rows, least, least_count, ratio, misspell):
    vocab = {w: n for w, n in counted(rows, misspell).items() if len(w) >= least and n >= least_count}
    out = {}
    for word, n in vocab.items():
        others = sorted(((-m, o) for o, m in vocab.items() if near(word, o)))
        form = others[0] if others and -others[0][0] >= ratio * n else None
        out[word] = [form[1] if form else None, n, len(others), -form[0] if form else None]
    result = []
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        result.append((word, form, root, n, n_near, form_n))
    return sorted(result)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abé", k=rng.randint(2, 7))) for _ in range(40)]
    weights = [1 / (i + 1) for i in range(len(stems))]
    rows = [(i, " ".join(rng.choices(stems, weights, k=rng.randint(0, 60)))) for i in range(n)]
    extra = [(None, "null id abab"), (7, None), (8, ""), (9, "123 - _"), rows[3], rows[3], (10, "AbÉ × ÷ Ÿ abé́ ß" * 3), (11, "a" * 70_000 + " " + "ba" * 60)]
    return rows + extra + [(20 + i, "é" * 100 + " " + "é" * 99 + "a") for i in range(6)]


def got(frame, **more):
    return sorted(tuple(r) for r in group_variants(frame, **more).collect())


@pytest.mark.parametrize("limit", [100_000, 6])
def test_against_all_pairs(spark, limit):
    rows = rows_of(1)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    for least, ratio in ((1, 2), (6, 5)):
        assert got(frame, least=least, least_count=2, ratio=ratio, misspell=3, limit=limit) == plain(rows, least, 2, ratio, 3)


def test_vocabulary_of_every_document(spark):
    rows = rows_of(2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = {r.word: r.n for r in vocabulary(frame, least=1, least_count=1, misspell=5).collect()}
    expected = counted(rows, 5)
    expected.pop("", None)
    assert words == expected


def test_chain_and_ties(spark):
    rows = [(i, t) for i, t in enumerate(["abcdefg"] * 625 + ["abcdefx"] * 125 + ["abcdexx"] * 25 + ["abcdxxx"] * 5 + ["qrstuv"] * 5 + ["qrstux"] * 25 + ["qrstua"] * 25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r[0]: r[1:] for r in got(frame, misspell=(1 << 32) - 1)}
    assert found["abcdxxx"] == ("abcdexx", "abcdefg", 5, 1, 25) and found["abcdefg"] == (None, "abcdefg", 625, 1, None)
    assert found["qrstuv"] == ("qrstua", "qrstua", 5, 2, 25) and found["qrstux"] == (None, "qrstux", 25, 2, None)


def test_hot_list_is_cut(spark):
    """All words share their first half, and all are in lists far beyond the limit."""
    words = ["abcd" + "".join(p) for p in __import__("itertools").product("abcde", repeat=4)]
    vocab = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    found = {(r.word, r.other) for r in near_words(vocab, limit=50).collect()}
    assert found == {(a, b) for a in words for b in words if near(a, b)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abéc", min_size=0, max_size=6), min_size=2, max_size=40))
def test_one_list(words):
    words = sorted(words)
    left, right = _near_in_list(words)
    assert sorted(zip(left.tolist(), right.tolist())) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)]


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    assert got(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == []
