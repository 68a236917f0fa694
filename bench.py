"""Time the headline queries once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loanline.queries import QUERIES
from loanline.session import build_session

HEADLINE = [
    "preprocess_steps",
    "new_records_null_safe",
    "string_index",
    "feature_vectors",
    "training_features",
    "stratified_split",
    "confusion_by_group",
    "roc_auc_with_ties",
    "json_metrics",
    "zip_params",
    "evaluation_log",
    "experiment_log",
    "registry_duplicates",
    "register_decisions",
    "uat_gate",
    "staging_promotion",
    "prod_promotion",
    "unknown_versions",
    "traffic_split",
    "keyed_replace",
    "incremental_preprocessing",
    "stream_incremental",
    "lr_train",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    for name in ("preprocess_steps", "best_version"):  # start-up cost
        run(name)
    times = {name: run(name) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
