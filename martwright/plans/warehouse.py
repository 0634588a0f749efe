"""The whole build: bronze → silver → gold → data tests → telemetry."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright import schemas
from martwright.functions.columns import as_stamp
from martwright.operators import gold, quality, silver, telemetry
from martwright.operators.quality import Check
from martwright.plans.suites import all_checks
from martwright.plans.telemetry_export import store_sections, telemetry_sections
from martwright.session import cut_lineage
from martwright.sources import tables
from martwright.sources.files import read_table

# Dashboards filter the fact by order date.
GOLD_ORDER = {"fct_sales": ["order_date"]}


def silver_layer(bronze: dict[str, DataFrame], as_of=None, today=None) -> dict[str, DataFrame]:
    """The six cleaned tables, lazy."""
    return {
        "stg_crm_cust_info": silver.stg_customer(bronze["crm_cust_info"], as_of),
        "stg_crm_prd_info": silver.stg_product(bronze["crm_prd_info"], as_of),
        "stg_crm_sales_details": silver.stg_sales(bronze["crm_sales_details"], as_of),
        "stg_erp_cust_az12": silver.stg_demographics(bronze["erp_cust_az12"], as_of, today),
        "stg_erp_loc_a101": silver.stg_location(bronze["erp_loc_a101"], as_of),
        "stg_erp_px_cat_g1v2": silver.stg_category(bronze["erp_px_cat_g1v2"], as_of),
    }


def build_gold(staged: dict[str, DataFrame], out: str, tiers=(10000, 50000)) -> dict[str, DataFrame]:
    """Write the gold tables; each reads its inputs as stored, not as recomputed."""
    stored: dict[str, DataFrame] = {}

    def store(name: str, frame: DataFrame) -> None:
        layer = {"gold": {name: frame}}
        stored.update(tables.materialize(layer, out, sort=GOLD_ORDER)["gold"])

    store(
        "dim_customers",
        gold.dim_customers(
            staged["stg_crm_cust_info"], staged["stg_erp_cust_az12"], staged["stg_erp_loc_a101"]
        ),
    )
    store(
        "dim_products",
        gold.dim_products(staged["stg_crm_prd_info"], staged["stg_erp_px_cat_g1v2"]),
    )
    store(
        "fct_sales",
        gold.fct_sales(
            staged["stg_crm_sales_details"], stored["dim_customers"], stored["dim_products"]
        ),
    )
    store("product_360", gold.product_360(stored["fct_sales"], stored["dim_products"], tiers))
    return stored


def declared_nodes(
    spark: SparkSession, models: dict[str, dict[str, DataFrame]], checks: list[Check]
) -> DataFrame:
    """Manifest nodes of the build itself: one per table and one per declared check."""
    ids = {name: f"model.{layer}.{name}" for layer, frames in models.items() for name in frames}
    rows = [
        (
            ids[name],
            "model",
            name,
            layer,
            {
                f.name: {"name": f.name, "description": "", "data_type": f.dataType.simpleString()}
                for f in frame.schema.fields
            },
            None,
            None,
        )
        for layer, frames in models.items()
        for name, frame in frames.items()
    ]
    rows += [
        (check_id(c.table, c.name), "test", c.name, None, {}, ids.get(c.table), c.column)
        for c in checks
    ]
    nodes = spark.createDataFrame(
        rows,
        "unique_id string, resource_type string, name string, schema string,"
        "columns map<string, struct<name: string, description: string, data_type: string>>,"
        "attached_node string, column_name string",
    )
    missing = ["alias", "database", "test_model"]
    return nodes.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])


def check_id(table: str, name: str) -> str:
    return f"test.{table}.{name}"


def suite_results(logs: DataFrame) -> DataFrame:
    """Execution-log rows of a suite as result rows."""
    stamp = F.date_format("run_timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return logs.select(
        F.col("execution_id").alias("invocation_id"),
        stamp.alias("invocation_started_at"),
        stamp.alias("generated_at"),
        F.concat(F.lit("test."), "target_table", F.lit("."), "node_name").alias("unique_id"),
        "status",
        F.col("execution_time_seconds").alias("execution_time"),
        F.col("rows_affected").alias("failures"),
        F.col("error_message").alias("message"),
    )


def build_warehouse(
    spark: SparkSession, source: str, out: str, run_id: str, as_of, unbroken: Collection[str] = ()
) -> dict:
    """Load, clean, model, test and record one run.

    ``unbroken`` names the bronze tables whose CSV files may be split over tasks.
    Silver is a set of views over rows stored for the session; bronze, gold and the telemetry
    sections are stored under ``out``. Returns every frame by layer plus the load log.
    """
    load_log = tables.load_bronze(spark, source, f"{out}/bronze", unbroken=unbroken)
    bronze = {
        name: read_table(spark, f"{out}/bronze/{name}", schema)
        for name, (_, schema) in schemas.BRONZE.items()
    }
    day = None if as_of is None else F.to_date(as_stamp(as_of))
    # Gold and the suite both read silver: it is computed once.
    staged = {name: cut_lineage(frame) for name, frame in silver_layer(bronze, as_of, day).items()}
    tables.materialize({"silver": staged}, out)
    stored = build_gold(staged, out)
    checks = all_checks(as_of)
    logs = quality.run_suite({**bronze, **staged, **stored}, checks, run_id, as_of)

    loads = tables.ingestion_log_rows(load_log, as_of, telemetry.LOAD_RESOURCE)
    loads = loads.withColumn("rows_inserted", F.col("destination_rows"))
    models = {"silver": staged, "gold": stored}
    no_sources = spark.createDataFrame(
        [], "unique_id string, source_name string, name string, identifier string, schema string"
    )
    sections = telemetry_sections(
        suite_results(logs),
        declared_nodes(spark, models, checks),
        no_sources,
        loads,
    )
    # The suite knows the table behind each of its checks, also in bronze.
    sections["execution_logs"] = logs
    return {
        "load_log": load_log,
        "bronze": bronze,
        **models,
        "telemetry": store_sections(spark, sections, f"{out}/telemetry", as_of),
    }
