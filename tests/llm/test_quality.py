from __future__ import annotations

import random
import re
from collections import Counter

from loanline.llm.quality import RULES, Rule, apply_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(words), len(inside)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


def fixture():
    draw = random.Random(2)
    rows = []
    for i in range(150):
        words = [draw.choice(["the", "a|", "und", "Éa", "x#y", "wörd", f"w{draw.randrange(50)}"]) for _ in range(draw.choice([0, 1, 7, 8, 9, 19, 20, 200]))]
        if i % 3 == 0:
            words += words[: draw.randrange(1, 30)]
        rows.append((i, "".join(w + draw.choice([" ", "\n", "\t ", "\r\n", "\x0b", " "]) for w in words)))
    return rows + [(900, None), (901, ""), (902, "\n \n"), (903, "x " * 30000), (None, "no id"), (3, rows[3][1]), (904, "\n".join(["same line here"] * 9)), (905, "😀 " * 25)]


def test_counts_against_brute_force(spark):
    rows = fixture()
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(((r.doc_id, *(r[n] for n in names)) for r in apply_rules(frame).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_rules(spark):
    good = "The house of the old man is in the middle of a small town, and it was built by his father long ago for them."
    texts = {
        "good": good,
        "symbols": good.replace(" ", "### "),
        "capitals": good.upper(),
        "marks": good.replace(" ", "!! "),
        "letters": " ".join(f"the {i * 7919} {i}" for i in range(30)),
        "stop_words": " ".join(f"abc{chr(97 + i % 26)}d{chr(97 + i // 26)}" for i in range(60)),
        "lists": "\n".join(f"- the {w} of it" for w in good.split()),
        "cut_lines": "\n".join(f"the {w} of it..." for w in good.split()),
        "long_words": " ".join(f"the {'abcdefghij' * 9}{i}" for i in range(30)),
    }
    rows = apply_rules(spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, text string")).collect()
    failed = {r.doc_id: r.failed for r in rows}
    assert failed.pop("good") == [] and next(r.kept for r in rows if r.doc_id == "good")
    assert all(name in found for name, found in failed.items()), failed
    assert all(r.kept == (not r.base_failed and not r.failed) for r in rows)
    none = apply_rules(spark.createDataFrame([(1, good)], "doc_id long, text string"), [Rule("r", "letter_share", most=0.1)]).first()
    assert none.failed == ["r"] and len(RULES) == len({r.name for r in RULES})


def test_one_projection_without_user_functions(spark):
    frame = spark.createDataFrame(fixture(), "doc_id long, text string")
    plan = apply_rules(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Generate" not in plan


def test_empty_and_labels(spark):
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = apply_rules(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in rows}
    print(count)
    assert count[1, True] > 0.9 * (count[1, True] + count.get((1, False), 0))
    assert count[0, False] > 0.7 * (count[0, False] + count.get((0, True), 0))
