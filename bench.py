"""Time the headline queries on the benchmark tables; prints one JSON line.

The given single-file tables are spread over the cores and the warehouse layers
stored on them first (``build_layers``, timed as well); the queries then run on
the stored layers. Queries named
``raw_…`` start from the given Parquet files instead.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from martwright.operators import silver  # noqa: E402
from martwright.plans.interaction import sales_page  # noqa: E402
from martwright.registry import Tables  # noqa: E402
from martwright.registry.catalog import CATALOG  # noqa: E402
from martwright.registry.dashboard import END, START  # noqa: E402
from martwright.registry.star import merged  # noqa: E402
from martwright.session import build_session, scratch_path  # noqa: E402

# Input table → the key that spreads it, or None for a small one.
INPUTS = {
    "lineitem": "l_orderkey",
    "orders": "o_orderkey",
    "documents": "doc_id",
    "part": None,
    "customer": None,
    "supplier": None,
    "nation": None,
}
LAYERS = [
    "fct_sales",
    "dim_products",
    "dim_customers",
    "crm_cust_info",
    "crm_sales_details",
    "node_models",
    "node_tests",
    "node_sources",
    "test_results",
]

ON_LAYERS = [
    "s10_merged_sales",
    "d02_kpi_totals",
    "d04_period_over_period",
    "d06_kpi_trend_product_monthly",
    "d07_kpi_trend_customer_monthly",
    "d10_sales_margin_monthly",
    "d12_revenue_by_country",
    "d14_top_products",
    "d19_customer_kpis",
    "d20_customer_detail",
    "d21_rfm_segments",
    "g05_product_360",
    "g06_customer_360",
    "a09_rank_customers_revenue",
    "a11_metric_audit",
    "a12_product_yoy",
    "a18_category_share",
    "v01_latest_per_key",
    "v20_stg_sales",
    "q10_run_suite",
    "q12_row_drift",
    "t02_execution_logs",
    "t04_model_coverage",
    "t23_redact_text",
]
# The operators themselves, without the rounding their registered form adds for
# the comparison with SQL.
BARE = {
    "s10_merged_sales": merged,
    "v20_stg_sales": lambda t: silver.stg_sales(t.crm_sales_details),
}
RAW = ["s10_merged_sales", "g05_product_360"]
# One interaction on the frame held in memory: filter, monthly trend, KPI change,
# country sums.
INTERACTION = ["trend", "change", "by_country"]


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def best(make) -> float:
    """One warm-up, then the better of two runs."""
    consume(make())
    return round(min(timed(lambda: consume(make())) for _ in range(2)), 3)


def store_layers(spark, folder: str, cores: int) -> Tables:
    """Split the single-file inputs over the cores, then store the layers on them."""
    landed = scratch_path(spark, "landed")
    for name, key in INPUTS.items():
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
        if key:
            frame = frame.repartition(cores, key)
        frame.write.parquet(f"{landed}/{name}.parquet")
    source, stored = Tables(spark, landed), {}
    for name in LAYERS:
        path = scratch_path(spark, name)
        getattr(source, name).write.parquet(path)
        stored[name] = path
    path = scratch_path(spark, "merged")
    merged(Tables(spark, landed, stored)).write.parquet(path)
    return Tables(spark, landed, {**stored, "merged": path})


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores)
    seconds: dict[str, float] = {}

    started = time.perf_counter()
    layers = store_layers(spark, folder, int(cores))
    seconds["build_layers"] = round(time.perf_counter() - started, 3)
    star = Tables(spark, layers.folder, {k: v for k, v in layers.stored.items() if k != "merged"})

    wanted = sys.argv[1:]
    for name in ON_LAYERS:
        if not wanted or name in wanted:
            # The star read itself joins the stored gold tables.
            source = star if name == "s10_merged_sales" else layers
            make = BARE.get(name, CATALOG[name].on)
            seconds[name] = best(lambda m=make, t=source: m(t))
    for name in RAW:
        if not wanted or name in wanted:
            make = BARE.get(name, CATALOG[name].on)
            seconds[f"raw_{name}"] = best(lambda m=make: m(Tables(spark, folder)))
    if not wanted:

        hot = layers.merged.cache()
        hot.count()

        def interaction():
            page = sales_page(hot, START, END)
            for part in INTERACTION:
                consume(page[part])

        interaction()
        seconds["one_interaction"] = round(min(timed(interaction) for _ in range(2)), 3)

    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
