"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. ``BENCH_ALL=1`` times
every query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from ledgerloom import build_session  # noqa: E402
from ledgerloom.metrics.registry import metric  # noqa: E402
from ledgerloom.plans import analyses  # noqa: E402
from ledgerloom.sources.files import full_refresh, open_current, shared_folder  # noqa: E402
from ledgerloom.sources.warehouse import distributor  # noqa: E402
from ledgerloom.workload.registry import queries  # noqa: E402

# over the raw tables: every view is derived inside the query
FROM_RAW = [
    "distributor_total_revenue",
    "analysis_otif_by_warehouse",
    "analysis_late_but_paid_fast",
    "revenue_by_segment_region_year",
    "revenue_yoy_by_segment",
    "distributor_supplier_lateness_cash_impact",
    "lateness_impact_customer_date",
    "distributor_slow_moving_inventory_value",
    "analysis_fast_and_slow_movers",
    "analysis_customers_hit_twice",
    "analysis_pareto_shares",
    "quality_foreign_keys_distributor",
    "insight_drivers_of_revenue",
    "retrieval_bm25",
    "retrieval_dense",
]
# over stored warehouse tables, as the published timings are; the first five have one
STORED = {
    "stored_total_revenue": lambda wh: metric("total_revenue").compute(wh),
    "stored_otif_by_warehouse": analyses.otif_by_warehouse,
    "stored_late_but_paid_fast": analyses.late_but_paid_fast,
    "stored_dso": lambda wh: metric("dso_days").compute(wh),
    "stored_top_suppliers_by_spend": analyses.top_suppliers_by_spend,
    "stored_cash_cycle": lambda wh: metric("cash_conversion_cycle_days").compute(wh),
    "stored_lateness_impact": lambda wh: metric("supplier_lateness_cash_impact").compute(wh),
    "stored_revenue_by_segment_region_year": lambda wh: metric("total_revenue").compute(
        wh, by=["dim_customer.segment", "dim_customer.region", "dim_date.year_num"]
    ),
}


def best_of(times: int, build: Callable[[], DataFrame]) -> float:
    runs = []
    for _ in range(times):
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - started)
    return round(min(runs), 4)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    # start the executor threads, the code generator and the file readers once
    every["analysis_revenue_by_segment"](spark, folder).collect()

    timings = {}
    if os.environ.get("BENCH_ALL"):
        for name in sorted(every):
            timings[name] = best_of(1, lambda: every[name](spark, folder))
    else:
        for name in FROM_RAW:
            timings[name] = best_of(2, lambda: every[name](spark, folder))
        target = shared_folder(spark, "bench")
        started = time.perf_counter()
        # a month of these tables is smaller than a file should be
        full_refresh(distributor(spark, folder), target, months=False)
        timings["publish_warehouse"] = round(time.perf_counter() - started, 4)
        stored = open_current(spark, "distributor", target)
        for name, build in STORED.items():
            timings[name] = best_of(3, lambda: build(stored))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
