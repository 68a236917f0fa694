"""Registration, version and alias decisions over tables of runs, versions and aliases."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanline.functions.maps import canonical_json, metric, with_default
from loanline.operators.components import connected_components
from loanline.operators.incremental import with_logged_flag
from loanline.operators.ordering import number_in_order
from loanline.operators.runs import first_per, top_runs
from loanline.operators.sizes import broadcast_if_small
from loanline.schemas import COMPARED_METRICS, PRIMARY_METRIC, TOLERANCE
from loanline.sources.folders import stored

# ---- fixed values: reasons written to the registration log ----
REGISTERED = "Registered successfully"
DUPLICATE = "Duplicate metrics+params → skipped"

# Cells take all compared metrics; at this many tolerances a run reaches one or two cells of a metric.
CELL_METRICS = len(COMPARED_METRICS)
CELL_WIDTH = 8.4
#: A fold compares each run with all it accepted, so it takes few; a slab finds them by their cells.
FOLD_RUNS, SLAB_RUNS = 200, 100_000


def compared(metrics: Sequence[str] = COMPARED_METRICS) -> Column:
    """Compared metric values in list order; an absent one counts as 0."""
    return F.array(*[with_default(metric("metrics", m)) for m in metrics])


def _near(a: Column, b: Column, tolerance: float) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda same: same)


def mark_near_duplicates(
    runs: DataFrame,
    versions: DataFrame,
    keys: Sequence[str] = ("model_name", "params_json"),
    tolerance: float = TOLERANCE,
    earlier: str | None = None,
) -> DataFrame:
    """Add ``duplicate``: some version has equal keys and every compared metric within tolerance.

    Both sides carry ``compared`` (array of doubles). Versions are first reduced to distinct
    metric values. Cells of several tolerances' width turn the band condition into
    an equi-join: a run looks into the one or two cells per metric its band touches, and a
    version is found in one of them only. With ``earlier`` a version counts only when its
    value of that column is smaller.
    """
    keys = list(keys)
    width, reach = CELL_WIDTH * tolerance or 1.0, 1.01 * tolerance
    known = versions.groupBy(*keys, "compared").agg(
        *([F.min(earlier).alias("since")] if earlier else [F.count(F.lit(1)).alias("since")])
    )

    def cell(value: Column) -> Column:
        return F.floor(value / width)

    cells = [f"cell_{i}" for i in range(CELL_METRICS)]
    own = {c: cell(F.coalesce(F.get("compared", F.lit(i)), F.lit(0.0))) for i, c in enumerate(cells)}
    known = known.withColumns(own).withColumnRenamed("compared", "stored")

    probes = runs.select(*keys, "compared", *([earlier] if earlier else [])).distinct()
    looking = probes
    for i, c in enumerate(cells):
        value = F.coalesce(F.get("compared", F.lit(i)), F.lit(0.0))
        looking = looking.withColumn(
            c, F.explode(F.array_distinct(F.array(cell(value - reach), cell(value + reach))))
        )
    match = _near(F.col("compared"), F.col("stored"), tolerance)
    if earlier:
        match = match & (F.col("since") < F.col(earlier))
    on = [*keys, *cells]
    left, right = looking.alias("l"), known.alias("r")
    condition = match
    for k in on:
        condition = condition & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    found = left.join(right, condition, "left_semi").select(*probes.columns).distinct()
    return with_logged_flag(runs, found, probes.columns, "duplicate")


def _turn(primary: str) -> Column:
    """Sorts runs best first, null metrics last, then by start and id."""
    value = metric("metrics", primary)
    return F.struct(value.isNull().alias("unmeasured"), (-value).alias("worse"), "start_time", "run_id")


def accept_in_order(candidates: DataFrame, tolerance: float = TOLERANCE, slab_runs: int = SLAB_RUNS) -> DataFrame:
    """Of runs with equal (model_name, params_json), those not near one accepted before them.

    Order matters because nearness is not transitive; ``turn`` gives it. Of equal metric values only the first run can
    be accepted, so copies are reduced first. Occupied cells that a run of another one may reach are linked, and their
    connected components, whose number of rounds grows with the logarithm of a chain, divide a group: runs of different
    components are never near. A component of up to FOLD_RUNS is decided by one fold in order, a larger one slab by slab.
    """
    keys = ["model_name", "params_json"]
    firsts = candidates.groupBy(*keys, "compared").agg(F.min("turn").alias("turn"))
    width, reach = CELL_WIDTH * tolerance or 1.0, 1.01 * tolerance
    cells = [f"cell_{i}" for i in range(CELL_METRICS)]
    values = [F.coalesce(F.get("compared", F.lit(i)), F.lit(0.0)) for i in range(CELL_METRICS)]
    node = F.xxhash64(*keys, *cells)  # equal hashes of different cells join components, which changes no result
    firsts = stored(firsts.withColumns({c: F.floor(v / width) for c, v in zip(cells, values, strict=True)}).withColumn("node", node), "firsts")
    looking = firsts.select(*keys, "compared", "node")
    for c, v in zip(cells, values, strict=True):
        looking = looking.withColumn(c, F.explode(F.array_distinct(F.array(F.floor((v - reach) / width), F.floor((v + reach) / width)))))
    occupied = firsts.select(F.col("node").alias("reached")).distinct()
    links = looking.select("node", node.alias("reached")).filter("node <> reached").distinct().join(occupied, "reached", "left_semi").select("node", "reached")
    parts = connected_components(links)
    by = [*keys, "component"]
    placed = firsts.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(placed.select(*by, "turn", "compared"), "placed")
    large = broadcast_if_small(placed.groupBy(*by).count().filter(F.col("count") > FOLD_RUNS).select(*by))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in by]
    group = placed.alias("p").join(large.alias("l"), same, "left_anti").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("turn", "compared"))).alias("runs"))
    none = F.filter("runs", lambda r: F.lit(False))
    accepted = F.aggregate(
        "runs",
        none,
        lambda kept, run: F.when(
            F.exists(kept, lambda k: _near(k["compared"], run["compared"], tolerance)), kept
        ).otherwise(F.concat(kept, F.array(run))),
    )
    folded = group.select("model_name", F.explode(F.transform(accepted, lambda r: r["turn"]["run_id"])).alias("run_id"))
    return folded.unionByName(_accept_by_slabs(placed.alias("p").join(large.alias("l"), same, "left_semi"), by, tolerance, slab_runs))


def _accept_by_slabs(runs: DataFrame, by: list[str], tolerance: float, slab_runs: int) -> DataFrame:
    """The accepted runs of large components, each cut into slabs along its widest metric.

    A slab is decided in order beside the runs of its neighbours that are in reach of it. A run waits while one of these,
    earlier and near, is not decided; a round decides at least the first run that waits, and as a rule a slab of each
    component. So a task has a slab and its edges, and no run is decided before those it depends on.
    """
    spark, width, reach = runs.sparkSession, CELL_WIDTH * tolerance or 1.0, 1.01 * tolerance
    runs = number_in_order(runs.withColumn("part", F.struct(*by)), "part", "turn").drop("part")
    runs = stored(runs.select(*by, "number", F.col("turn.run_id").alias("run_id"), "compared"), "numbered")
    if runs.isEmpty():
        return runs.select("model_name", "run_id")
    values = [F.coalesce(F.get("compared", F.lit(i)), F.lit(0.0)) for i in range(CELL_METRICS)]
    spans = [F.struct((F.max(v) - F.min(v)).alias("span"), F.lit(i).alias("axis")) for i, v in enumerate(values)]
    widest = broadcast_if_small(runs.groupBy(*by).agg(F.greatest(*spans)["axis"].alias("axis")))
    runs = _on_equal(runs, widest, by).withColumn("value", F.coalesce(F.get("compared", "axis"), F.lit(0.0)))
    own = F.floor(F.col("value") / width).alias("cell")
    counts = runs.groupBy(*by, own).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    # The occupied cells of one metric, not the runs, are put in order; a slab takes whole cells, so only edges are shared.
    slabs = broadcast_if_small(counts.select(*by, "cell", F.floor(F.coalesce(upto, F.lit(0)) / slab_runs).alias("slab")))
    near = [F.floor((F.col("value") + step) / width) for step in (0.0, -reach, reach)]
    seen = runs.select(*by, "number", "run_id", "compared", F.posexplode(F.array(*near)).alias("step", "cell"))
    seen = _on_equal(seen, slabs, [*by, "cell"]).groupBy(*by, "number").agg(
        F.first("run_id").alias("run_id"),
        F.first("compared").alias("compared"),
        F.max(F.when(F.col("step") == 0, F.col("slab"))).alias("slab"),
        F.collect_set("slab").alias("slabs"),
    )
    state = stored(seen.withColumn("accepted", F.lit(False)), "waiting")
    step, schema, decided = _slab_step(tolerance, width, reach), state.schema, []
    while not (waiting := state.filter("NOT accepted")).isEmpty():
        open_slabs = broadcast_if_small(waiting.select(*by, F.col("slab").alias("at")).distinct())
        known = waiting.unionByName(reduce(DataFrame.unionByName, decided)) if decided else waiting
        meeting = _on_equal(known.withColumn("at", F.explode("slabs")), open_slabs, [*by, "at"])
        state = stored(meeting.groupBy(*by, "at").applyInPandas(step, schema), "waiting")
        decided.append(state.filter("accepted"))
    return reduce(DataFrame.unionByName, decided).select("model_name", "run_id")


def _on_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join where null equals null, with the keys once."""
    condition = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    more = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), condition).select("l.*", *more)


def _slab_step(tolerance: float, width: float, reach: float):
    """Decide what can be decided of a slab: returns its runs that are newly accepted and those that still wait."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        def cell(value: float) -> int:
            return math.floor(value / width) if math.isfinite(value) else 0

        def meets(places: dict, run: list[float]) -> bool:
            sides = [{cell(x - reach), cell(x + reach)} for x in run]
            found = (k for at in itertools.product(*sides) for k in places.get(at, ()))
            return any(all(abs(x - y) <= tolerance for x, y in zip(k, run, strict=True)) for k in found)

        kept, waits, states = {}, {}, []
        rows = rows.sort_values(["accepted", "number"], ascending=[False, True], ignore_index=True)
        own = (rows["slab"] == rows["at"]).to_numpy()
        for known, mine, values in zip(rows["accepted"], own, rows["compared"], strict=True):
            run = [float(x) for x in values]
            if known:
                kept.setdefault(tuple(map(cell, run)), []).append(run)
                states.append(None)
            elif meets(kept, run):
                states.append(None)
            elif not mine or meets(waits, run):
                waits.setdefault(tuple(map(cell, run)), []).append(run)
                states.append(False if mine else None)
            else:
                kept.setdefault(tuple(map(cell, run)), []).append(run)
                states.append(True)
        told = [s is not None for s in states]
        return rows[told].assign(accepted=[s for s in states if s is not None]).drop(columns="at")

    return step


def register_decisions(
    runs: DataFrame,
    log: DataFrame,
    versions: DataFrame,
    model_name: Column,
    when: Column,
    primary: str = PRIMARY_METRIC,
    tolerance: float = TOLERANCE,
    limit: int | None = None,
    check_duplicates: bool = True,
) -> DataFrame:
    """One row per run found, with its ``outcome``: logged, duplicate or registered.

    Runs are taken best first. A run already logged is left alone; one near a stored version,
    or near a run accepted before it, is a duplicate; the rest get the next version numbers.
    ``versions`` has model_name, version, params_json and ``compared``. ``limit`` takes only so
    many of the unlogged runs of each model type, the best first.
    """
    params = F.coalesce(canonical_json("params"), F.lit("{}"))
    found = with_logged_flag(runs, log, ["run_id"])
    if limit is not None:
        fresh = top_runs(found.filter(~F.col("already_logged")), primary, True, limit)
        found = found.filter("already_logged").unionByName(fresh)
    found = found.withColumns(
        {"model_name": model_name, "params_json": params, "compared": compared(), "turn": _turn(primary)}
    )
    fresh = found.filter(~F.col("already_logged"))
    if check_duplicates:
        marked = mark_near_duplicates(fresh, versions, tolerance=tolerance)
        accepted = accept_in_order(marked.filter(~F.col("duplicate")), tolerance)
    else:
        accepted = fresh.select("model_name", "run_id")
    outcome = with_logged_flag(found, accepted, ["model_name", "run_id"], "registered")

    turns = outcome.filter("registered").select("model_name", "turn")
    numbered = outcome.join(number_in_order(turns, "model_name", "turn"), ["model_name", "turn"], "left")
    newest = versions.groupBy("model_name").agg(F.max("version").alias("newest"))
    number = F.coalesce("newest", F.lit(0)) + F.col("number")
    value = metric("metrics", primary)
    return (
        numbered.join(newest, "model_name", "left")
        .withColumn("version", F.when(F.col("registered"), number.cast("int")))
        .select(
            when.alias("timestamp"),
            "run_id",
            F.coalesce("run_name", F.lit("unnamed_run")).alias("run_name"),
            "model_type",
            "model_name",
            "experiment_name",
            F.lit(primary).alias("primary_metric"),
            with_default(value).alias("primary_metric_value"),
            canonical_json(F.map_from_arrays(F.array(*map(F.lit, COMPARED_METRICS)), _raw_compared())).alias(
                "metrics_json"
            ),
            "params_json",
            "registered",
            F.coalesce(F.col("version").cast("string"), F.lit("N/A")).alias("registered_version"),
            F.when(F.col("registered"), REGISTERED).otherwise(DUPLICATE).alias("reason"),
            F.when(F.col("already_logged"), "logged")
            .when(F.col("registered"), "registered")
            .otherwise("duplicate")
            .alias("outcome"),
            "version",
            "metrics",
        )
    )


def _raw_compared() -> Column:
    return F.array(*[metric("metrics", m) for m in COMPARED_METRICS])


def version_rows(decisions: DataFrame) -> DataFrame:
    """Rows of newly registered versions, with what later registrations compare by."""
    return decisions.filter(F.col("outcome") == "registered").select(
        "model_name",
        "version",
        "run_id",
        F.lit("READY").alias("status"),
        F.col("timestamp").alias("creation_timestamp"),
        "params_json",
        compared().alias("compared"),
    )


def registration_log_rows(decisions: DataFrame) -> DataFrame:
    """Rows to append to the registration log."""
    return decisions.filter(F.col("outcome") != "logged").drop("outcome", "version", "metrics")


def registration_summary(decisions: DataFrame) -> DataFrame:
    """Registered, skipped and total per model type, and over all in the row named "all"."""
    kind = F.when(F.grouping("model_type") == 1, "all").otherwise(F.col("model_type"))
    return decisions.rollup("model_type").agg(
        kind.alias("scope"),
        F.count_if(F.col("outcome") == "registered").alias("registered"),
        F.count_if(F.col("outcome") != "registered").alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    ).drop("model_type")


def version_tags(decisions: DataFrame, metrics: Sequence[str] = COMPARED_METRICS) -> DataFrame:
    """Version rows with the tags a registered version carries; metrics rounded to 4 places."""
    return decisions.filter(F.col("registered")).select(
        "model_name",
        "version",
        "run_id",
        "run_name",
        "model_type",
        "primary_metric",
        F.round("primary_metric_value", 4).alias("primary_metric_value"),
        F.col("timestamp").alias("registered_timestamp"),
        *[F.round(metric("metrics", m), 4).alias(f"metric_{m}") for m in metrics],
    )


def version_metrics(versions: DataFrame, runs: DataFrame, name: str = PRIMARY_METRIC) -> DataFrame:
    """Versions with the metric of the run they came from; null when the run or metric is absent."""
    return versions.join(runs.select("run_id", metric("metrics", name).alias("metric")), "run_id", "left")


def resolve_alias(aliases: DataFrame, versions: DataFrame, runs: DataFrame, alias: str) -> DataFrame:
    """Model, version, run and run name an alias points to."""
    named = aliases.filter(F.col("alias") == alias)
    return named.join(versions, ["model_name", "version"]).join(runs, "run_id")


def best_version(measured: DataFrame, maximize: bool = True) -> DataFrame:
    """READY version with the best metric per model; the lower version on ties."""
    ready = measured.filter(F.col("metric").isNotNull() & (F.col("status") == "READY"))
    best = F.desc("metric") if maximize else F.asc("metric")
    return first_per(ready, ["model_name"], [best, F.asc("version")])


def staging_decisions(measured: DataFrame, aliases: DataFrame, alias: str = "Staging", maximize: bool = True) -> DataFrame:
    """Whether the best version takes the alias, and why."""
    best = best_version(measured, maximize).select("model_name", F.col("version").alias("best"), "metric")
    held = aliases.filter(F.col("alias") == alias).select("model_name", F.col("version").alias("current"))
    current, new = F.col("current"), F.col("best")
    named = F.concat(F.lit("v"), new.cast("string"))
    reason = (
        F.when(current.isNull(), F.concat(named, F.lit(" is the best version, none was staged")))
        .when(current == new, F.concat(named, F.lit(" is staged and still the best")))
        .otherwise(F.concat(named, F.lit(" is better than the staged v"), current.cast("string")))
    )
    decided = best.join(held, "model_name", "left")
    return decided.withColumns({"promote": current.isNull() | (current != new), "reason": reason})


def promoted_aliases(decisions: DataFrame, alias: str) -> DataFrame:
    """Alias rows to upsert on (model_name, alias)."""
    return decisions.filter(F.col("promote")).select(
        "model_name", F.lit(alias).alias("alias"), F.col("best").alias("version")
    )


def latest_results(results: DataFrame) -> DataFrame:
    """Newest result of each model version."""
    return first_per(results, ["model_name", "model_version"], [F.desc("timestamp"), F.asc("run_id")])


def production_decisions(
    aliases: DataFrame, versions: DataFrame, results: DataFrame, staging: str = "Staging"
) -> DataFrame:
    """Staging versions with their newest acceptance result; only PASSED ones are promoted."""
    staged = aliases.filter(F.col("alias") == staging).join(versions, ["model_name", "version"])
    wanted = staged.select("model_name", F.col("version").cast("string").alias("model_version"), "version")
    evidence = results.join(wanted.select("model_name", "model_version"), ["model_name", "model_version"], "left_semi")
    decided = wanted.join(latest_results(evidence), ["model_name", "model_version"], "left")
    return decided.select(
        "model_name",
        F.col("version").alias("best"),
        F.coalesce(F.col("uat_status") == "PASSED", F.lit(False)).alias("promote"),
        *["uat_status", "accuracy", "precision", "recall", "f1", "roc_auc"],
    )


def unknown_versions(plan: DataFrame, versions: DataFrame) -> DataFrame:
    """Active rows of a deployment plan whose version is not registered."""
    return plan.filter("active").join(versions, ["model_name", "version"], "left_anti")


def traffic_totals(plan: DataFrame, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Sum of the active percentages per endpoint, and whether it is 100."""
    totals = plan.filter("active").groupBy(*by).agg(F.sum("traffic").alias("total_traffic"))
    return totals.withColumn("valid", F.col("total_traffic") == 100)


def traffic_routes(plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The 100 slots of each endpoint (named by the columns ``by``) and the version each goes to, in plan order."""
    active = plan.filter("active")
    own = Window.partitionBy(*(by or [F.lit(0)]))  # an endpoint has at most 100 active versions
    upto = F.sum("traffic").over(own.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    shares = active.withColumn("until", upto).withColumn("total", F.sum("traffic").over(own))
    wrong = F.concat(F.lit("traffic percentages add up to "), F.col("total").cast("string"))
    checked = shares.withColumn(
        "until", F.when(F.col("total") == 100, F.col("until")).otherwise(F.raise_error(wrong).cast("bigint"))
    )
    slots = F.sequence((F.col("until") - F.col("traffic")).cast("int"), (F.col("until") - 1).cast("int"))
    routed = checked.filter(F.col("traffic") > 0)
    return routed.select(*by, "model_name", "version", F.explode(slots).alias("slot"))


def hash_slot(key: str) -> Column:
    """Slot 0..99 of a key, from the first 15 hex digits of its hash."""
    digits = F.substring(F.md5(F.col(key).cast("string")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(100)).cast("int")


def route_rows(df: DataFrame, plan: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Give each row the model version its hashed key falls to, at the endpoint that its columns ``by`` name.

    Fails on a row whose endpoint has no active version.
    """
    routes = broadcast_if_small(traffic_routes(plan, by))
    routed = df.withColumn("slot", hash_slot(key)).join(routes, [*by, "slot"], "left")
    none = F.raise_error(F.lit("no active version to route to")).cast("string")
    return routed.withColumn("model_name", F.coalesce("model_name", none))
