from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loanline.operators import registry
from loanline.operators.runs import best_runs, experiment_rows, name_contains, top_runs
from loanline.schemas import COMPARED_METRICS, RUNS

BEGIN = datetime(2024, 1, 1)
VERSIONS = "model_name string, version int, params_json string, compared array<double>"


def _runs(spark, rows):
    """rows: (run_id, metrics, params) of one model type, an hour apart."""
    full = [
        (rid, f"loan_rf_{rid}", "exp", "random_forest", BEGIN + timedelta(hours=i), m, p, "uri")
        for i, (rid, m, p) in enumerate(rows)
    ]
    return spark.createDataFrame(full, RUNS)


def _decide(spark, runs, logged=(), versions=(), **options):
    log = spark.createDataFrame([(r,) for r in logged], "run_id string")
    stored = spark.createDataFrame(list(versions), VERSIONS)
    found = registry.register_decisions(runs, log, stored, F.lit("m"), F.lit(BEGIN), **options).collect()
    return {r.run_id: (r.outcome, r.registered_version) for r in found}


def test_nearness_is_judged_in_order(spark):
    """a~b and b~c but not a~c: b falls to a, so c is registered."""
    runs = _runs(spark, [(n, {"test_recall": v}, {"p": "1"}) for n, v in (("a", 0.5), ("b", 0.4), ("c", 0.3))])
    assert _decide(spark, runs, tolerance=0.12) == {
        "a": ("registered", "1"), "b": ("duplicate", "N/A"), "c": ("registered", "2"),
    }


def test_logged_and_stored_runs(spark):
    runs = _runs(spark, [(n, {"test_recall": v}, {"p": "1"}) for n, v in (("a", 0.9), ("b", 0.8), ("c", 0.7))])
    stored = [("m", 7, '{"p":"1"}', [0.0, 0.0, 0.8, 0.0, 0.0, 0.0])]
    assert _decide(spark, runs, logged=["a"], versions=stored) == {
        "a": ("logged", "N/A"), "b": ("duplicate", "N/A"), "c": ("registered", "8"),
    }


def test_other_parameters_are_no_duplicate(spark):
    runs = _runs(spark, [("a", {"test_recall": 0.9}, {"p": "1"}), ("b", {"test_recall": 0.9}, {"p": "2"})])
    assert {o for o, _ in _decide(spark, runs).values()} == {"registered"}


def test_absent_metric_counts_as_zero(spark):
    runs = _runs(spark, [("a", {"test_recall": 0.9, "test_f1": 0.0}, {}), ("b", {"test_recall": 0.9}, {})])
    assert sorted(o for o, _ in _decide(spark, runs).values()) == ["duplicate", "registered"]


def test_check_can_be_switched_off(spark):
    runs = _runs(spark, [(n, {"test_recall": 0.9}, {}) for n in "ab"])
    assert {o for o, _ in _decide(spark, runs, check_duplicates=False).values()} == {"registered"}


def test_no_runs(spark):
    assert _decide(spark, _runs(spark, [])) == {}


@pytest.mark.parametrize("limit", [500, None])
def test_decisions_equal_one_by_one(spark, limit):
    """Chains of near runs, copies and two parameter sets, against a plain loop."""
    draw = random.Random(11)
    rows = []
    for i in range(80):
        level = 0.5 if i % 3 == 0 else round(draw.random() / 3, 3)
        rows.append((f"r{i:02}", {"test_recall": level, "test_f1": round(draw.randrange(3) / 50, 3)}, {"p": str(i % 2)}))
    stored = [("m", 3, '{"p":"0"}', [0.0, 0.0, 0.1, 0.0, 0.0, 0.0])]
    found = _decide(spark, _runs(spark, rows), versions=stored, tolerance=0.02, limit=limit)

    kept, want = [(stored[0][2], 0.1, 0.0)], {}
    for rid, m, p in sorted(rows, key=lambda r: (-r[1]["test_recall"], r[0])):
        text, a, b = f'{{"p":"{p["p"]}"}}', m["test_recall"], m["test_f1"]
        if any(t == text and abs(x - a) <= 0.02 and abs(y - b) <= 0.02 for t, x, y in kept):
            want[rid] = ("duplicate", "N/A")
        else:
            kept.append((text, a, b))
            want[rid] = ("registered", str(len(kept) + 2))
    assert found == want
    assert sum(o == "registered" for o, _ in want.values()) > 5


def test_numbers_across_ranges(spark):
    df = spark.range(500).selectExpr("CAST(id % 2 AS string) AS g", "id * 7 % 500 AS t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = registry.number_in_order(df, "g", "t").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in "01":
        assert [r.number for r in sorted((r for r in found if r.g == g), key=lambda r: r.t)] == list(range(1, 251))


@pytest.mark.parametrize("tolerance", [0.0, 0.001, 0.01])
def test_near_duplicates_equal_all_pairs(spark, tolerance):
    """Values on a grid of the tolerance, so that many differences are exactly at the bound."""
    draw = random.Random(3)
    step = tolerance or 0.01

    def point():
        return [round(draw.randrange(4) * step, 6) for _ in range(6)]

    new = [(f"r{i}", "m", "p" if i % 3 else "q", point()) for i in range(150)]
    old = [("m", "p" if i % 3 else "q", point()) for i in range(60)]
    runs = spark.createDataFrame(new, "run_id string, model_name string, params_json string, compared array<double>")
    stored = spark.createDataFrame(old, "model_name string, params_json string, compared array<double>")
    found = registry.mark_near_duplicates(runs, stored, tolerance=tolerance).collect()
    assert len(found) == len(new)
    want = {
        rid: any(p == q and all(abs(x - y) <= tolerance for x, y in zip(c, d, strict=True)) for _, q, d in old)
        for rid, _, p, c in new
    }
    assert {r.run_id: r.duplicate for r in found} == want
    assert any(want.values()) or tolerance == 0


def test_twins_of_copies(spark):
    """A third of the rows are copies of one run: all but the first are twins."""
    rows = [(f"r{i:03}", "m", "p", [0.5 if i % 3 == 0 else float(i)] * 6) for i in range(90)]
    df = spark.createDataFrame(rows, "run_id string, model_name string, params_json string, compared array<double>")
    found = registry.mark_near_duplicates(df, df, earlier="run_id").filter("duplicate").count()
    assert found == 29


def test_best_and_top_runs(spark):
    rows = [("a", {"test_recall": 0.5}, {}), ("b", {"test_recall": 0.5}, {}), ("c", {}, {}), ("d", {"test_recall": 0.1}, {})]
    runs = _runs(spark, rows).withColumn("run_name", F.lit("same"))
    assert best_runs(runs).first().run_id == "a"  # the earlier one on ties
    assert best_runs(runs, maximize=False).first().run_id == "d"
    assert [r.run_id for r in top_runs(runs, limit=3).orderBy("run_id").collect()] == ["a", "b", "d"]
    assert {r.run_id for r in top_runs(runs, limit=4).collect()} == {"a", "b", "c", "d"}  # nulls come last


def test_name_filter(spark):
    runs = _runs(spark, [("a", {}, {}), ("b", {}, {})])
    runs = runs.withColumn("run_name", F.when(F.col("run_id") == "a", F.lit("x_xgboost_1")))
    assert [r.run_id for r in name_contains(runs, "xgboost").collect()] == ["a"]


def test_experiment_log_takes_the_first_of_equal_settings(spark):
    runs = _runs(spark, [("a", {}, {"x": "1", "y": "2"}), ("b", {}, {"y": "2", "x": "1"}), ("c", {}, {"x": "3"})])
    empty = spark.createDataFrame([], "model_type string, experiment_name string, hyperparameters string")
    rows = experiment_rows(runs, empty, F.lit(BEGIN))
    assert sorted(r.run_id for r in rows.collect()) == ["a", "c"]
    assert experiment_rows(runs, rows, F.lit(BEGIN)).count() == 0
    assert experiment_rows(runs, rows, F.lit(BEGIN), check_log=False).count() == 3


def _versions(spark, rows):
    return spark.createDataFrame(rows, "model_name string, version int, status string, metric double")


def test_best_version_is_ready_and_measured(spark):
    df = _versions(spark, [("m", 1, "READY", 0.5), ("m", 2, "PENDING", 0.9), ("m", 3, "READY", None), ("m", 4, "READY", 0.5)])
    assert registry.best_version(df).first().version == 1


def test_staging_cases(spark):
    df = _versions(spark, [(m, v, "READY", v / 10) for m, v in itertools.product("abc", (1, 2))])
    held = spark.createDataFrame([("a", "Staging", 2), ("b", "Staging", 1), ("c", "Production", 2)], "model_name string, alias string, version int")
    found = {r.model_name: (r.promote, r.reason) for r in registry.staging_decisions(df, held).collect()}
    assert found == {
        "a": (False, "v2 is staged and still the best"),
        "b": (True, "v2 is better than the staged v1"),
        "c": (True, "v2 is the best version, none was staged"),
    }


def test_production_needs_the_newest_result_to_pass(spark):
    aliases = spark.createDataFrame([(m, "Staging", 1) for m in "abc"], "model_name string, alias string, version int")
    versions = spark.createDataFrame([(m, 1) for m in "abc"], "model_name string, version int")
    results = spark.createDataFrame(
        [
            ("a", "1", BEGIN, "r", "FAILED"), ("a", "1", BEGIN + timedelta(1), "r", "PASSED"),
            ("b", "1", BEGIN, "r", "PASSED"), ("b", "1", BEGIN + timedelta(1), "r", "FAILED"),
        ],
        "model_name string, model_version string, timestamp timestamp, run_id string, uat_status string",
    )
    for metric in ("accuracy", "precision", "recall", "f1", "roc_auc"):
        results = results.withColumn(metric, F.lit(0.5))
    found = {r.model_name: (r.promote, r.uat_status) for r in registry.production_decisions(aliases, versions, results).collect()}
    assert found == {"a": (True, "PASSED"), "b": (False, "FAILED"), "c": (False, None)}


def _plan(spark, shares):
    rows = [("m", i, s, True, i) for i, s in enumerate(shares)]
    return spark.createDataFrame(rows, "model_name string, version int, traffic bigint, active boolean, position int")


def test_routes_cover_all_slots(spark):
    routes = registry.traffic_routes(_plan(spark, [70, 0, 30])).collect()
    assert sorted(r.slot for r in routes) == list(range(100))
    assert sum(r.version == 0 for r in routes) == 70 and not any(r.version == 1 for r in routes)


def test_shares_must_add_up(spark):
    with pytest.raises(Exception, match="add up to 90"):
        registry.traffic_routes(_plan(spark, [60, 30])).collect()


def test_routing_is_whole_and_repeatable(spark):
    rows = spark.range(2000)
    first = registry.route_rows(rows, _plan(spark, [50, 50]), "id")
    assert first.count() == 2000
    assert first.exceptAll(registry.route_rows(rows.repartition(5), _plan(spark, [50, 50]), "id")).count() == 0
    assert 850 < first.filter("version = 0").count() < 1150


def test_each_endpoint_has_its_plan_and_an_empty_plan_fails(spark):
    plan = _plan(spark, [50, 50]).withColumn("endpoint", F.lit("a")).unionByName(
        _plan(spark, [100, 0]).withColumn("endpoint", F.lit("b"))
    )
    rows = spark.range(400).selectExpr("id", "if(id % 2 = 0, 'a', 'b') AS endpoint")
    routed = registry.route_rows(rows, plan, "id", ["endpoint"])
    assert routed.count() == 400
    assert {(r.endpoint, r.version) for r in routed.collect()} == {("a", 0), ("a", 1), ("b", 0)}
    with pytest.raises(Exception, match="no active version"):
        registry.route_rows(rows, _plan(spark, [50, 50]).filter("false"), "id").collect()


def test_jobs_do_not_grow_with_a_chain(spark):
    def jobs(links: int) -> int:
        rows = [(f"r{i:04}", {m: i * 0.0006 for m in COMPARED_METRICS}, {"p": "1"}) for i in range(links)]
        group = f"chain-{links}"
        spark.sparkContext.setJobGroup(group, group)
        found = _decide(spark, _runs(spark, rows))
        spark.sparkContext.setJobGroup("", "")
        assert sum(o == "registered" for o, _ in found.values()) == links // 2
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    short, long = jobs(16), jobs(1024)
    assert long <= short + 60, (short, long)


def test_logged_runs_do_not_use_up_a_limit(spark):
    runs = _runs(spark, [(f"r{i}", {"test_recall": 0.9 - i / 100}, {"p": str(i)}) for i in range(8)])
    found = _decide(spark, runs, logged=[f"r{i}" for i in range(5)], limit=2)
    assert {k for k, (o, _) in found.items() if o == "registered"} == {"r5", "r6"}

def test_large_components_are_decided_slab_by_slab(spark):
    """Chains in and against their order and a cloud, in slabs of a few runs, against a plain loop in order."""
    draw = random.Random(5)
    chains = [(f"m{step}", [k * step * 0.0006] * 6) for step in (1, -1) for k in range(700)]
    cloud = [("cloud", [draw.random() / 25, draw.random() / 50, *[0.5] * 4]) for _ in range(1500)]
    rows = [(name, "{}", v, (draw.random() if name == "cloud" else float(i), f"r{i:05d}")) for i, (name, v) in enumerate([*chains, *cloud])]
    df = spark.createDataFrame(rows, "model_name string, params_json string, compared array<double>, turn struct<worse: double, run_id: string>")
    kept, expected = {}, set()
    for name, _, run, turn in sorted(rows, key=lambda r: r[3]):
        if not any(all(abs(x - y) <= 0.001 for x, y in zip(k, run)) for k in kept.get(name, [])):
            kept.setdefault(name, []).append(run)
            expected.add((name, turn[1]))
    for slab_runs in (90, 100_000):
        found = [tuple(r) for r in registry.accept_in_order(df, 0.001, slab_runs).select("model_name", "run_id").collect()]
        assert len(found) == len(set(found)) and set(found) == expected
