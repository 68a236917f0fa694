"""python tests/check_all.py [sf_dir] [name ...]: compare queries and print their times."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

import __spark_entry__ as contract
from tests.compare import connect, differences


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        took, began = -1.0, time.perf_counter()
        try:
            df = query(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            found = differences(df, con, sql[name]) if name in sql else [f"rows only: {df.count()}"]
        except Exception as error:  # report every query
            lines = str(error).splitlines()
            causes = [line for line in lines if line.startswith("Caused by")]
            found = [f"{type(error).__name__}: {' '.join([lines[0], *causes])[:600]}"]
            traceback.print_exc()
        bad += bool(found) and name in sql
        print(f"\n{took:6.2f}s {name}: {'; '.join(found) or 'ok'}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
