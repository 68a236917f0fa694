from __future__ import annotations

import os

import pytest

from loanline.sources import drop_replaced, read_buckets, replace_in_buckets
from loanline.sources import buckets as module

SCHEMA = "name string, version string, value int"
KEYS = ["name", "version"]


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def held(spark, target):
    return sorted((tuple(r) for r in read_buckets(spark, target, SCHEMA).select("name", "version", "value").collect()), key=str)


def part_files(folder):
    return [f for _, _, files in os.walk(folder) for f in files if f.endswith(".parquet")]


def test_replacements_against_a_dictionary(spark, folder):
    target, want = f"{folder}/t", {}
    steps = [
        [(f"m{i}", "007", i) for i in range(300)],
        [(f"m{i}", "007", -i) for i in range(0, 300, 7)] + [("new", None, 1), (None, None, 2), ("", "1", 3)],
        [(None, None, 5), ("new", None, 6), ("new", "x", 7)],
        [("m1", "007", None)],
    ]
    for step in steps:
        for _ in range(2):  # a rerun changes nothing
            assert replace_in_buckets(rows(spark, step), target, KEYS, buckets=8) == len(step)
        want |= {(n, v): x for n, v, x in step}
        assert held(spark, target) == sorted(((*k, x) for k, x in want.items()), key=str)
    # in another order of columns, with narrower types and another number of buckets: the table keeps its own
    odd = spark.createDataFrame([(9, "007", "m2")], "value short, version string, name string")
    replace_in_buckets(odd, target, KEYS, buckets=3)
    assert held(spark, target) == sorted(((*k, x) for k, x in (want | {("m2", "007"): 9}).items()), key=str)


def test_rows_of_a_key_are_kept_and_replaced_together(spark, folder):
    target = f"{folder}/t"
    replace_in_buckets(rows(spark, [("a", "1", 1), ("a", "1", 2), ("b", "1", 3)]), target, KEYS)
    replace_in_buckets(rows(spark, [("a", "1", 8), ("a", "1", 8), ("a", "1", 9)]), target, KEYS)
    assert held(spark, target) == [("a", "1", 8), ("a", "1", 8), ("a", "1", 9), ("b", "1", 3)]


def test_nothing_to_store(spark, folder):
    target = f"{folder}/t"
    assert replace_in_buckets(rows(spark, []), target, KEYS) == 0
    assert held(spark, target) == []
    with pytest.raises(ValueError, match="nothing was stored"):
        read_buckets(spark, target)
    replace_in_buckets(rows(spark, [("a", "1", 1)]), target, KEYS)
    assert replace_in_buckets(rows(spark, []), target, KEYS) == 0
    assert held(spark, target) == [("a", "1", 1)]


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, folder, monkeypatch):
    target, first, second = f"{folder}/t", [("a", "1", 1), ("b", "1", 2)], [("a", "1", 5), ("c", "1", 6)]
    replace_in_buckets(rows(spark, first), target, KEYS, buckets=2)

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(module, "append", dies)
        with pytest.raises(RuntimeError, match="lost"):
            replace_in_buckets(rows(spark, second), target, KEYS)
    assert held(spark, target) == first
    replace_in_buckets(rows(spark, second), target, KEYS)
    want = [("a", "1", 5), ("b", "1", 2), ("c", "1", 6)]
    assert held(spark, target) == want
    assert drop_replaced(spark, target) > 0
    assert held(spark, target) == want and drop_replaced(spark, target) == 0


def test_files_are_bounded_by_buckets(spark, folder):
    target = f"{folder}/t"
    for turn in range(3):
        replace_in_buckets(rows(spark, [(f"m{i}", str(turn), i) for i in range(2000)]), target, KEYS, buckets=4)
    drop_replaced(spark, target)
    assert len(part_files(f"{target}/rows")) <= 4 and read_buckets(spark, target).count() == 6000
    assert read_buckets(spark, target).columns == ["name", "version", "value"]
