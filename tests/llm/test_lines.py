from __future__ import annotations

import random
import re

from loanline.llm import lines as module
from loanline.llm.lines import dedup_lines, drop_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_words=50):
    """Chunks by their lines; a chunk stays with its smallest id."""
    found, where = [], {}
    for n, (doc, text) in enumerate(rows):
        if text is None:
            continue
        kept = [(i, line, len(WORD.findall(line))) for i, line in enumerate(text.split("\n"))]
        kept = [x for x in kept if x[2]]
        for first in range(len(kept)):
            total = 0
            for last in range(first, len(kept)):
                total += kept[last][2]
                if total > min_words and (total - kept[first][2] <= min_words or total - kept[last][2] <= min_words):
                    key = tuple(x[1] for x in kept[first : last + 1])
                    found.append((n, doc, key, kept[first][0], kept[last][0]))
                    where.setdefault(key, set()).add(doc)
    gone = {n: set() for n in range(len(rows))}
    for n, doc, key, low, high in found:
        named = [d for d in where[key] if d is not None]
        if named and len(where[key]) > 1 and doc != min(named):
            gone[n] |= set(range(low, high + 1))
    out = []
    for n, (doc, text) in enumerate(rows):
        body = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[n])
        out.append((doc, 0 if text is None else text.count("\n") + 1, len(gone[n]), body))
    return sorted(out, key=str)


def fixture():
    draw = random.Random(6)

    def line(n):
        return " ".join(f"{draw.choice('abcdé')}{draw.randrange(400)}" for _ in range(n))

    passages = ["\n".join(line(n) for n in sizes) for sizes in ([51], [50], [60], [20, 20, 20], [5] * 11, [5] * 10, [30, 10, 10, 9, 1], [200, 3, 4])]
    rows = []
    for i in range(120):
        parts = [line(draw.randrange(1, 90))]
        for _ in range(draw.randrange(3)):
            parts += [draw.choice(passages), *[line(draw.randrange(0, 30)) for _ in range(draw.randrange(3))]]
        rows.append((i, "\n".join(parts)))
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, rows[3][1].replace("\n", "\n\n \t\n")), (303, None), (304, ""), (305, "\n\n")]
    rows += [(306, passages[3] + "\n" + passages[3]), (None, passages[0]), (None, "only " * 60), (None, "only " * 60), (4, rows[4][1]), (4, line(99))]
    rows += [(400, "\n".join(line(8) for _ in range(3000))), (401, "long " * 200000), (402, "long " * 200000)]
    return rows


def rows_of(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in frame.collect()), key=str)


def test_against_brute_force(spark):
    rows = fixture()
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, row string").repartition(3)
    assert rows_of(dedup_lines(frame)) == brute(rows)


def test_equal_hashes_of_differing_lines_remove_nothing(spark, monkeypatch):
    rows = fixture()[:60]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(module.F, "xxhash64", lambda *c: module.F.crc32(module.F.concat_ws(",", *[module.F.col(x).cast("string") if isinstance(x, str) else module.F.array_join(x.cast("array<string>"), ",") for x in c])) % 50)
    chunks = module.line_chunks(frame.select("doc_id", "text", module.F.col("doc_id").cast("string").alias("row")))
    assert chunks.select("hash").distinct().count() <= 50
    monkeypatch.setattr(module, "row_key", lambda *c: module.F.col("doc_id").cast("string"))
    got = rows_of(dedup_lines(frame))
    want = brute(rows)
    # a colliding hash may hide a repeat behind an owner with other bytes, but what goes must be a true repeat
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))


def test_dropping(spark):
    rows = fixture()
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, hash string")
    kept = drop_repeats(frame)
    assert kept.columns == frame.columns
    want = [(d, t) for d, _, n, t in brute(rows) if not n or WORD.search(t)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundaries_move_with_their_passage(spark):
    """A passage of over 50 words has one boundary at least that does not depend on where it stands, and few in all."""
    draw = random.Random(4)
    line = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    passages = [[line(n) for n in sizes] for sizes in ([51], [26, 25], [3] * 18, [10] * 30, [1] * 60)]
    rows = []
    for i, passage in enumerate(passages):
        for copy in range(3):
            rows.append((10 * i + copy, "\n".join([line(draw.randrange(1, 40)) for _ in range(40)] + passage + [line(9) for _ in range(copy)])))
    rows.append((900, "\n".join(line(5) for _ in range(2000))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", module.F.col("doc_id").cast("string"))
    chunks = module.line_chunks(frame)
    found = {}
    for r in chunks.collect():
        found.setdefault(r.doc_id, set()).add(r.boundary)
    for i in range(len(passages)):
        assert found[10 * i] & found[10 * i + 1] & found[10 * i + 2]
    assert len(found[900]) < 2000 / 3  # two of the ten or eleven lines of a stretch, as for any least value of a window
    repeated = {r.doc_id for r in module.repeated_chunks(chunks).collect()}
    assert repeated == {10 * i + copy for i in range(len(passages)) for copy in range(3)}
