"""Registration, versions, aliases, promotion and traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanline.functions import canonical_json
from loanline.operators import registry
from loanline.plans.lifecycle import promote_to_production, promote_to_staging, register, register_and_store
from loanline.queries.runs import earlier_runs, json_sql
from loanline.queries.standins import (
    BASE_MODEL,
    LOGGED_BEFORE,
    NOW_TEXT,
    acceptance,
    aliases,
    model_of,
    moment,
    now,
    oracle,
    registered,
    runs,
    table,
    versions,
)
from loanline.schemas import ALIASES, COMPARED_METRICS, REGISTRATION_LOG, STORED_VERSIONS
from loanline.sources import replace_keys, scan, work_folder


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(
        "run_id", model_of().alias("model_name"), canonical_json("params").alias("params_json"),
        registry.compared().alias("compared"),
    )


def registry_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs near a version registered earlier, same model and parameters."""
    marked = registry.mark_near_duplicates(_judged(spark, sf_dir), registered(spark, sf_dir), tolerance=0.05)
    return marked.select("run_id", "duplicate")


def earlier_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a near run of smaller id."""
    judged = _judged(spark, sf_dir)
    return registry.mark_near_duplicates(judged, judged, tolerance=0.1, earlier="run_id").select("run_id", "duplicate")


DECISION_TOLERANCE = 0.1
WIDE_TOLERANCE = 0.2


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs began after the versions were registered; a third of those are logged already."""
    log = earlier_runs(spark, sf_dir).filter(F.col("params")["criterion"] == "gini")
    return registry.register_decisions(
        runs(spark, sf_dir), log, registered(spark, sf_dir), model_of(), now(), tolerance=DECISION_TOLERANCE
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("model_name", "run_id", "outcome", "registered_version", "reason")


def decisions_of_all_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a search limit, nothing logged yet and a wider tolerance."""
    nothing = earlier_runs(spark, sf_dir).select("run_id").limit(0)
    decided = registry.register_decisions(
        runs(spark, sf_dir), nothing, registered(spark, sf_dir), model_of(), now(), tolerance=WIDE_TOLERANCE, limit=None
    )
    return decided.select("model_name", "run_id", "outcome", "registered_version")


def registration_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registration_log_rows(_decided(spark, sf_dir)).select(*REGISTRATION_LOG.fieldNames())


def registration_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered twice through the stored log: the second time every run is logged already."""
    target = work_folder(spark, "registrations")
    known = registered(spark, sf_dir)
    when = moment(NOW_TEXT).cast("timestamp")
    for _ in range(2):
        register(spark, runs(spark, sf_dir), known, target, model_of(), when)
    log = scan(spark, target, REGISTRATION_LOG)
    return log.groupBy("model_type", "registered").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("registered_version") == "N/A").alias("unversioned")
    )


def registration_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored versions after the early runs, then all runs, then all runs once more."""
    log, known = work_folder(spark, "registrations"), work_folder(spark, "versions")
    every, when = runs(spark, sf_dir), moment(NOW_TEXT).cast("timestamp")
    for batch in (every.filter(F.col("start_time") < moment(LOGGED_BEFORE)), every, every):
        register_and_store(spark, batch, known, log, model_of(), when, tolerance=DECISION_TOLERANCE)
    return scan(spark, known, STORED_VERSIONS).select("model_name", "version", "run_id", "params_json")


def registration_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer a run, each near the next one alone: every second one is registered."""
    key = F.col("c_custkey").cast("double")
    values = {m: key * 6 / 10000 for m in COMPARED_METRICS}
    chain = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("chain_"), F.col("c_custkey").cast("string")).alias("run_id"),
        F.lit("chain").alias("run_name"), F.lit("chain").alias("experiment_name"), F.lit("random_forest").alias("model_type"),
        now().alias("start_time"), F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())).alias("metrics"),
        F.create_map(F.lit("depth"), F.lit("1")).alias("params"),
    )
    nothing, none = chain.select("run_id").limit(0), registered(spark, sf_dir).limit(0)
    decided = registry.register_decisions(chain, nothing, none, model_of(), now())
    return decided.select("run_id", "outcome", "registered_version")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registration_summary(_decided(spark, sf_dir))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.version_tags(_decided(spark, sf_dir))


def version_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version whose run is gone keeps a null metric."""
    kept = runs(spark, sf_dir).filter(F.col("start_time") >= moment(LOGGED_BEFORE))
    found = registry.version_metrics(versions(spark, sf_dir), kept, "test_roc_auc")
    return found.select("model_name", "version", "run_id", "status", "metric")


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.resolve_alias(aliases(spark, sf_dir), versions(spark, sf_dir), runs(spark, sf_dir), "Staging")
    return found.select("model_name", "alias", "version", "run_id", "run_name")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.version_metrics(versions(spark, sf_dir), runs(spark, sf_dir))


def best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.best_version(_measured(spark, sf_dir)).select("model_name", "version", "metric")


def best_version_minimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.best_version(_measured(spark, sf_dir), maximize=False).select("model_name", "version", "metric")


def best_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best version of each model with its run, stored under the model name."""
    target = work_folder(spark, "best")
    best = registry.best_version(_measured(spark, sf_dir)).withColumnRenamed("metric", "primary_metric_value")
    replace_keys(best.select("run_id", "version", "status", "primary_metric_value", "model_name"), target, ["model_name"])
    schema = "run_id string, version int, status string, primary_metric_value double, model_name string"
    return scan(spark, target, schema)


def staging_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.staging_decisions(_measured(spark, sf_dir), aliases(spark, sf_dir))


def uat_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest_results(acceptance(spark, sf_dir)).select(
        "model_name", "model_version", "timestamp", "uat_status", "accuracy"
    )


def production_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.production_decisions(aliases(spark, sf_dir), versions(spark, sf_dir), acceptance(spark, sf_dir))


def promotion_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias table after both promotions; the best versions are staged first."""
    target = work_folder(spark, "aliases")
    replace_keys(aliases(spark, sf_dir), target, ["model_name", "alias"])
    known = versions(spark, sf_dir)
    promote_to_staging(spark, known, runs(spark, sf_dir), target)
    promote_to_production(spark, known, target, acceptance(spark, sf_dir))
    return scan(spark, target, ALIASES)


def unknown_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned deployments (an order line: part as model, supplier as version) nobody registered."""
    lines = table(spark, sf_dir, "lineitem")
    plan = lines.select(
        F.col("l_partkey").alias("model_name"), F.col("l_suppkey").alias("version"), "l_orderkey", "l_linenumber",
        (F.col("l_linestatus") == "O").alias("active"),
    )
    known = lines.filter(F.col("l_returnflag") == "N").select(
        F.col("l_partkey").alias("model_name"), F.col("l_suppkey").alias("version")
    )
    return registry.unknown_versions(plan, known).select("l_orderkey", "l_linenumber", "model_name", "version")


def traffic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each order (endpoint) over its open lines (versions)."""
    plan = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("endpoint"), F.col("l_quantity").cast("bigint").alias("traffic"),
        (F.col("l_linestatus") == "O").alias("active"),
    )
    return registry.traffic_totals(plan)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    share = F.when(key == 0, 50).when(key == 1, 30).when(key == 2, 20).when(key == 3, 0).otherwise(70)
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit(BASE_MODEL), F.lower("r_name")).alias("model_name"),
        (key + 1).alias("version"), share.cast("bigint").alias("traffic"), (key < 4).alias("active"),
        key.alias("position"),
    )


def traffic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return registry.route_rows(orders, _plan(spark, sf_dir), "o_orderkey")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each order status; one sends all to its first version, one splits in two."""
    endpoint = F.explode(F.array(*map(F.lit, "FOP"))).alias("o_orderstatus")
    plan = _plan(spark, sf_dir).select("*", endpoint)
    place = F.col("position")
    single = F.when(place == 0, 100).otherwise(0)
    double = F.when(place == 0, 40).when(place == 1, 60).otherwise(0)
    share = F.when(F.col("o_orderstatus") == "F", F.col("traffic")).when(F.col("o_orderstatus") == "O", single).otherwise(double)
    return plan.withColumn("traffic", share.cast("bigint"))


def traffic_split_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return registry.route_rows(orders, _plans(spark, sf_dir), "o_orderkey", ["o_orderstatus"])


_EARLIER = f"start_time < TIMESTAMP '{LOGGED_BEFORE}'"
_COMPARED = ", ".join(f"coalesce({m}, 0) AS v{i}" for i, m in enumerate(COMPARED_METRICS))
_JUDGED = f"SELECT run_id, model_name, params_json, start_time, {_COMPARED} FROM runs"


def _near(a: str, b: str, tolerance: float) -> str:
    bands = " AND ".join(
        f"abs({a}.v{i} - {b}.v{i}) <= CAST({tolerance} AS DOUBLE)" for i in range(len(COMPARED_METRICS))
    )
    return f"{a}.model_name = {b}.model_name AND {a}.params_json = {b}.params_json AND {bands}"


_KEPT_NEAR = " AND ".join(
    f"abs(k.v[{i + 1}] - c.v{i}) <= CAST({DECISION_TOLERANCE} AS DOUBLE)" for i in range(len(COMPARED_METRICS))
)
_WALK = {
    "judged": _JUDGED,
    "found": """SELECT r.*, j.* EXCLUDE (run_id, model_name, params_json, start_time),
 row_number() OVER (PARTITION BY r.model_name ORDER BY test_recall DESC, r.start_time, r.run_id) AS place
 FROM runs r JOIN judged j ON r.run_id = j.run_id""",
    "candidates": f"""SELECT *, place AS p,
 {_EARLIER} AND criterion = 'gini' AS logged,
 EXISTS (SELECT 1 FROM judged v WHERE v.{_EARLIER} AND {_near("v", "f", DECISION_TOLERANCE)}) AS known
 FROM found f""",
    "walk": f"""SELECT DISTINCT model_name, CAST(0 AS BIGINT) AS place,
  CAST([] AS STRUCT(run_id VARCHAR, params_json VARCHAR, v DOUBLE[])[]) AS kept FROM candidates
 UNION ALL
 SELECT w.model_name, c.place, CASE WHEN c.logged OR c.known OR len(list_filter(w.kept, lambda k:
   k.params_json = c.params_json AND {_KEPT_NEAR})) > 0
  THEN w.kept ELSE list_append(w.kept, {{'run_id': c.run_id, 'params_json': c.params_json,
   'v': [{", ".join(f"c.v{i}" for i in range(len(COMPARED_METRICS)))}]}}) END
 FROM walk w JOIN candidates c ON c.model_name = w.model_name AND c.place = w.place + 1""",
    "accepted": """SELECT unnest(list_transform(kept, lambda k: k.run_id)) AS run_id FROM walk
 WHERE (model_name, place) IN (SELECT (model_name, max(place)) FROM walk GROUP BY model_name)""",
    "newest": f"SELECT model_name, max(user_id + 1) AS newest FROM runs WHERE {_EARLIER} GROUP BY model_name",
    "decided": """SELECT c.*, a.run_id IS NOT NULL AS registered,
 coalesce(n.newest, 0) + count(a.run_id) OVER (PARTITION BY c.model_name ORDER BY c.place) AS number,
 CASE WHEN logged THEN 'logged' WHEN a.run_id IS NOT NULL THEN 'registered' ELSE 'duplicate' END AS outcome
 FROM candidates c LEFT JOIN accepted a ON a.run_id = c.run_id LEFT JOIN newest n ON n.model_name = c.model_name""",
}
_WALK_ALL = {
    name: sql.replace(f"CAST({DECISION_TOLERANCE} AS DOUBLE)", f"CAST({WIDE_TOLERANCE} AS DOUBLE)")
    .replace(f"{_EARLIER} AND criterion = 'gini' AS logged", "FALSE AS logged")
    for name, sql in _WALK.items()
}
_WALK_BATCHES = {
    name: sql.replace("ORDER BY test_recall DESC", f"ORDER BY r.{_EARLIER} DESC, test_recall DESC")
    .replace(f"{_EARLIER} AND criterion = 'gini' AS logged", "FALSE AS logged")
    .replace(" EXISTS (SELECT 1 FROM judged v", " FALSE AND EXISTS (SELECT 1 FROM judged v")
    .replace("coalesce(n.newest, 0) + ", "")
    for name, sql in _WALK.items()
}
_VERSION = "CASE WHEN registered THEN CAST(number AS VARCHAR) ELSE 'N/A' END AS registered_version"
_REASON = f"CASE WHEN registered THEN '{registry.REGISTERED}' ELSE '{registry.DUPLICATE}' END AS reason"
_READY = """SELECT v.model_name, v.version, v.run_id, v.status, r.test_recall AS metric
 FROM versions v JOIN runs r ON r.run_id = v.run_id WHERE status = 'READY'"""
_BEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY metric DESC, version) AS nth
 FROM ready) WHERE nth = 1"""
_STAGED = f"""SELECT b.model_name, b.version AS best, b.metric, a.version AS current,
 a.version IS NULL OR a.version <> b.version AS promote,
 CASE WHEN a.version IS NULL THEN 'v' || b.version || ' is the best version, none was staged'
      WHEN a.version = b.version THEN 'v' || b.version || ' is staged and still the best'
      ELSE 'v' || b.version || ' is better than the staged v' || a.version END AS reason
 FROM best b LEFT JOIN aliases a ON a.model_name = b.model_name"""
_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, model_version
 ORDER BY "timestamp" DESC, run_id) AS nth FROM acceptance) WHERE nth = 1"""

QUERIES = {
    "registry_duplicates": (
        registry_duplicates,
        oracle(
            f"""SELECT run_id, EXISTS (SELECT 1 FROM judged v WHERE v.{_EARLIER} AND {_near("v", "j", 0.05)}) AS duplicate
FROM judged j""",
            "runs",
            judged=_JUDGED,
        ),
    ),
    "registry_twins": (
        earlier_twins,
        oracle(
            f"""SELECT run_id, EXISTS (SELECT 1 FROM judged v WHERE v.run_id < j.run_id AND {_near("v", "j", 0.1)})
 AS duplicate FROM judged j""",
            "runs",
            judged=_JUDGED,
        ),
    ),
    "register_decisions": (
        decisions,
        oracle(f"SELECT model_name, run_id, outcome, {_VERSION}, {_REASON} FROM decided", "runs", **_WALK),
    ),
    "register_decisions_unlimited": (
        decisions_of_all_runs,
        oracle(f"SELECT model_name, run_id, outcome, {_VERSION} FROM decided", "runs", **_WALK_ALL),
    ),
    "registration_log": (
        registration_log,
        oracle(
            f"""SELECT TIMESTAMP '{NOW_TEXT}' AS "timestamp", run_id, run_name, model_type, model_name, experiment_name,
 'test_recall' AS primary_metric, test_recall AS primary_metric_value,
 {json_sql(COMPARED_METRICS, nulls=True)} AS metrics_json, params_json, registered, {_VERSION}, {_REASON}
FROM decided WHERE outcome <> 'logged'""",
            "runs",
            **_WALK,
        ),
    ),
    "registration_job": (
        registration_job,
        oracle(
            """SELECT model_type, registered, count(*) AS n,
 CASE WHEN registered THEN 0 ELSE count(*) END AS unversioned FROM decided GROUP BY model_type, registered""",
            "runs",
            **{
                name: sql.replace(f"CAST({DECISION_TOLERANCE} AS DOUBLE)", "CAST(0.001 AS DOUBLE)").replace(
                    f"{_EARLIER} AND criterion = 'gini' AS logged", "FALSE AS logged"
                )
                for name, sql in _WALK.items()
            },
        ),
    ),
    "registration_two_batches": (
        registration_two_batches,
        oracle(
            "SELECT model_name, CAST(number AS INTEGER) AS version, run_id, params_json FROM decided WHERE registered",
            "runs",
            **_WALK_BATCHES,
        ),
    ),
    "registration_chain": (
        registration_chain,
        """WITH placed AS (SELECT c_custkey, max(c_custkey) OVER () - c_custkey AS behind FROM customer)
SELECT 'chain_' || c_custkey AS run_id, CASE WHEN behind % 2 = 0 THEN 'registered' ELSE 'duplicate' END AS outcome,
 CASE WHEN behind % 2 = 0 THEN CAST(behind // 2 + 1 AS VARCHAR) ELSE 'N/A' END AS registered_version FROM placed""",
    ),
    "registration_summary": (
        summary,
        oracle(
            """SELECT coalesce(model_type, 'all') AS scope, count(*) FILTER (WHERE outcome = 'registered') AS registered,
 count(*) FILTER (WHERE outcome <> 'registered') AS skipped, count(*) AS total FROM decided GROUP BY ROLLUP (model_type)""",
            "runs",
            **_WALK,
        ),
    ),
    "version_tags": (
        tags,
        oracle(
            f"""SELECT model_name, CAST(number AS INTEGER) AS version, run_id, run_name, model_type,
 'test_recall' AS primary_metric, round(test_recall, 4) AS primary_metric_value,
 TIMESTAMP '{NOW_TEXT}' AS registered_timestamp, {", ".join(f"round({m}, 4) AS metric_{m}" for m in COMPARED_METRICS)}
FROM decided WHERE registered""",
            "runs",
            **_WALK,
        ),
    ),
    "version_metrics": (
        version_metrics,
        oracle(
            f"""SELECT v.model_name, v.version, v.run_id, v.status, r.test_roc_auc AS metric FROM versions v
LEFT JOIN runs r ON r.run_id = v.run_id AND NOT r.{_EARLIER}""",
            "versions",
        ),
    ),
    "alias_resolution": (
        alias_resolution,
        oracle(
            """SELECT a.model_name, a.alias, a.version, v.run_id, r.run_name FROM aliases a
JOIN versions v ON v.model_name = a.model_name AND v.version = a.version JOIN runs r ON r.run_id = v.run_id""",
            "versions",
            "aliases",
        ),
    ),
    "best_version": (
        best_version,
        oracle("SELECT model_name, version, metric FROM best", "versions", ready=_READY, best=_BEST),
    ),
    "best_version_minimize": (
        best_version_minimize,
        oracle(
            "SELECT model_name, version, metric FROM best",
            "versions",
            ready=_READY,
            best=_BEST.replace("metric DESC", "metric"),
        ),
    ),
    "best_model_table": (
        best_model_table,
        oracle(
            "SELECT run_id, version, status, metric AS primary_metric_value, model_name FROM best",
            "versions",
            ready=_READY,
            best=_BEST,
        ),
    ),
    "staging_promotion": (
        staging_promotion,
        oracle("SELECT * FROM staged", "versions", "aliases", ready=_READY, best=_BEST, staged=_STAGED),
    ),
    "uat_latest": (
        uat_latest,
        oracle(
            'SELECT model_name, model_version, "timestamp", uat_status, accuracy FROM latest',
            "acceptance",
            latest=_LATEST,
        ),
    ),
    "prod_promotion": (
        production_promotion,
        oracle(
            """SELECT a.model_name, a.version AS best, coalesce(l.uat_status = 'PASSED', FALSE) AS promote, l.uat_status,
 l.accuracy, l."precision", l.recall, l.f1, l.roc_auc FROM aliases a LEFT JOIN latest l
 ON l.model_name = a.model_name AND l.model_version = CAST(a.version AS VARCHAR)""",
            "acceptance",
            "aliases",
            latest=_LATEST,
        ),
    ),
    "promotion_job": (
        promotion_job,
        oracle(
            """SELECT model_name, 'Staging' AS alias, best AS version FROM staged
UNION ALL SELECT s.model_name, 'Production', s.best FROM staged s JOIN latest l ON l.model_name = s.model_name
 AND l.model_version = CAST(s.best AS VARCHAR) AND l.uat_status = 'PASSED'""",
            "versions",
            "aliases",
            "acceptance",
            ready=_READY,
            best=_BEST,
            staged=_STAGED,
            latest=_LATEST,
        ),
    ),
    "unknown_versions": (
        unknown_versions,
        """SELECT l_orderkey, l_linenumber, l_partkey AS model_name, l_suppkey AS version FROM lineitem l
WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'N'
 AND k.l_partkey = l.l_partkey AND k.l_suppkey = l.l_suppkey)""",
    ),
    "traffic_totals": (
        traffic_check,
        """SELECT l_orderkey AS endpoint, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_traffic,
 sum(CAST(l_quantity AS BIGINT)) = 100 AS valid FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey""",
    ),
    "traffic_split_endpoints": (
        traffic_split_endpoints,
        f"""WITH slotted AS (SELECT o_orderkey, o_orderstatus,
 CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 100 AS INTEGER) AS slot FROM orders)
SELECT s.slot, s.o_orderkey, s.o_orderstatus, '{BASE_MODEL}' || lower(r_name) AS model_name, r_regionkey + 1 AS version
FROM slotted s JOIN region ON r_regionkey = CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN CASE WHEN slot < 40 THEN 0 ELSE 1 END
 ELSE CASE WHEN slot < 50 THEN 0 WHEN slot < 80 THEN 1 ELSE 2 END END""",
    ),
    "traffic_split": (
        traffic_split,
        f"""WITH slotted AS (SELECT o_orderkey,
 CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 100 AS INTEGER) AS slot FROM orders)
SELECT s.slot, s.o_orderkey, '{BASE_MODEL}' || lower(r_name) AS model_name, r_regionkey + 1 AS version
FROM slotted s JOIN region ON r_regionkey = CASE WHEN slot < 50 THEN 0 WHEN slot < 80 THEN 1 ELSE 2 END""",
    ),
}
