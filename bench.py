"""Time the headline queries, warm (better of two runs), and print one JSON line.

BENCH_SF_DIR  folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ALL     1 = every registered query
BENCH_DUCKDB  1 = also time each query's SQL in DuckDB, printed to stderr
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tabweave.session import local_session
from workload import ORACLES, QUERIES

HEADLINE = [
    "flagship_sales_by_region_year",
    "agg_sum",
    "agg_distinct_count",
    "agg_statistics",
    "calculate_filter",
    "calculate_all",
    "calculate_allexcept",
    "calc_group_expand",
    "compound_measure",
    "hierarchy_rollup",
    "preaggregate",
    "row_context_metric",
    "total_ytd",
    "same_period_last_year",
    "dates_in_period",
    "rankx",
    "dedupe_first",
    "fn_math",
    "checksum_udf",
    "conditional_split",
    "surrogate_key",
    "top_n",
    "lookup_first_match",
    "merge_join_full",
    "related_table",
    "star_join",
    "hierarchy_expand",
    "rls_mapping",
    "column_mask",
    "measure_parity",
    "type_safety_profile",
    "status_scorecard",
    "dependency_levels",
    "cdc_diff",
    "cdc_net_changes",
    "cdc_merge",
    "delimited_source",
    "clustered_write",
    "stream_cdc_foreach_batch",
    "incremental_aggregate",
]


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    spark = local_session("bench", cores, **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        run(name)
        times[name] = round(min(seconds(lambda: run(name)) for _ in range(2)), 3)
    if os.environ.get("BENCH_DUCKDB") == "1":
        from check import connect

        con = connect(sf_dir)
        con.execute(f"SET threads = {cores}")
        for name in names:
            fetch = lambda: con.execute(ORACLES[name]).to_arrow_table()
            fetch()
            print(f"{name:32s} {times[name]:8.3f} {seconds(fetch):8.3f}", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
