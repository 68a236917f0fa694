from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from loanline.llm.simhash import fingerprint_links, keep_one, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted(((d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=str)


def texts():
    draw = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(50)] + ["É", "ñandú", "AbC"]
    for i in range(60):
        body = [draw.choice(words) for _ in range(draw.choice([1, 2, 3, 30, 400]))]
        rows.append((i * 3, " ".join(body)))
        if i % 4 == 0:
            body[-1] = "changed"
            rows.append((1000 + i, "\t\n".join(body).upper() if i % 8 else " ".join(body)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (0, rows[0][1]), (None, "one"), (5005, "x " * 200000)]


def test_against_brute_force(spark):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = near_duplicates(frame.repartition(3)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(rows)


def test_links_of_crowded_buckets(spark):
    draw = random.Random(4)
    centres = [draw.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(4))) for c in centres for _ in range(150)}
    values |= {(centres[0] & ~0xFFFF) | draw.getrandbits(16) for _ in range(200)}
    want = sorted((a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    frame = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    for crowded in (1, 8, 10**9):
        rows = fingerprint_links(frame, crowded).collect()
        assert sorted(tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in rows) == want


def test_keep_one(spark):
    rows = texts()
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, star string")
    kept = keep_one(frame)
    assert kept.columns == frame.columns  # a column named like one of ours stays
    want = {d for d, _, c in brute(rows) if d == c and d is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted(want)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
