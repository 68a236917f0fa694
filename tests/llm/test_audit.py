from __future__ import annotations

import itertools
import random
import re

from loanline.llm import audit


def fails(doc_id, text, rows):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    earlier = doc_id is not None and any(t == text and d is not None and d < doc_id for d, t in rows)
    return {
        letter
        for letter, failed in zip(
            "ABCDE",
            [
                len(words) < 100,
                100 * len(set(words)) < 80 * len(words),
                100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                any(c in "#$%&*|" for c in text),
                earlier,
            ],
        )
        if failed
    }


def plain(rows, labels):
    """Every order applied document by document."""
    keyed = [(d, t or "") for d, t, _ in rows]
    docs = [(d, part or "", fails(d, t or "", keyed)) for d, t, part in rows]
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    orders = list(itertools.permutations("ABCDE"))
    out = []
    for part in {p for _, p, _ in docs}:
        here = [(d, f) for d, p, f in docs if p == part]
        removed = {(o, s): [(d, f) for d, f in here if o[s] in f and not f & set(o[:s])] for o in orders for s in range(5)}
        for o in orders:
            for s in range(5):
                gone = removed[o, s]
                kept = sum(not f & set(o[: s + 1]) for _, f in here)
                redundant = sum(o[s] in f and bool(f & set(o[:s])) for _, f in here)
                unique = sum(f == {o[s]} for _, f in here)
                shapley = sum(len(removed[p, p.index(o[s])]) for p in orders)
                out.append((part, "".join(o), s + 1, kept, len(gone), redundant, unique, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), shapley))
    return sorted(out)


def sample():
    rng = random.Random(3)
    words = ["alpha", "beta", "GAMMA", "d#", "épsilon", "ζ"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.sample(words[4:], 120)), " ".join(rng.choices(words, k=150)), " ".join(rng.sample(words, 110)), "SHORT TEXT", "", None, " \t\n ", "a $", "x " * 50_000]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(None, texts[0], "en"), (None, "alone", "fr"), (3, texts[0], "en"), (3, texts[2], "de"), rows[5], rows[5], (-4, texts[1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1)]
    return rows, labels


def test_against_every_order(spark):
    rows, labels = sample()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, hash int, bits int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.audit_filters(frame, marks).collect())
    assert got == plain(rows, labels)


def test_hot_text_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(audit, "ROWS_A_SALT", 5)
    rows = [(i, "same", "en") for i in range(500, 0, -1)] + [(i, f"own {i}", "en") for i in range(1000, 1010)]
    copies = audit.earlier_copies(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in copies.collect()) == list(range(2, 501))


def test_equal_hash_is_not_enough(spark, monkeypatch):
    real = audit.F.xxhash64
    monkeypatch.setattr(audit.F, "xxhash64", lambda c: audit.F.length(c).cast("long") if not isinstance(c, str) else real(c))
    rows = [(1, "aaa"), (2, "bbb"), (3, "aaa"), (4, "ccc"), (5, "bbb"), (6, "dd")]
    copies = audit.earlier_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in copies.collect()) == [3, 5]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs, marks).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = audit.audit_filters(one, marks).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120
