"""Declared table schemas: bronze, merged frame, audit and telemetry."""

from pyspark.sql import types as T


def table(spec: str) -> T.StructType:
    """``"name type, …"`` to a StructType without needing a session."""
    kinds = {
        "long": T.LongType(),
        "double": T.DoubleType(),
        "string": T.StringType(),
        "date": T.DateType(),
        "timestamp": T.TimestampType(),
        "boolean": T.BooleanType(),
    }
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


# Bronze tables, their source files and declared columns.
BRONZE = {
    "crm_cust_info": (
        "source_crm/cust_info.csv",
        table(
            "cst_id long, cst_key string, cst_firstname string, cst_lastname string,"
            "cst_marital_status string, cst_gndr string, cst_create_date string"
        ),
    ),
    "crm_prd_info": (
        "source_crm/prd_info.csv",
        table(
            "prd_id long, prd_key string, prd_nm string, prd_cost double,"
            "prd_line string, prd_start_dt string, prd_end_dt string"
        ),
    ),
    "crm_sales_details": (
        "source_crm/sales_details.csv",
        table(
            "sls_ord_num string, sls_prd_key string, sls_cust_id long, sls_order_dt long,"
            "sls_ship_dt long, sls_due_dt long, sls_sales double, sls_quantity long,"
            "sls_price double"
        ),
    ),
    "erp_cust_az12": (
        "source_erp/CUST_AZ12.csv",
        table("cid string, bdate string, gen string"),
    ),
    "erp_loc_a101": ("source_erp/LOC_A101.csv", table("cid string, cntry string")),
    "erp_px_cat_g1v2": (
        "source_erp/PX_CAT_G1V2.csv",
        table("id string, cat string, subcat string, maintenance string"),
    ),
}

GOLD_TABLES = ["fct_sales", "dim_products", "dim_customers", "product_360"]

MERGED_COLUMNS = [
    "product_key",
    "customer_key",
    "order_date",
    "order_number",
    "quantity",
    "gross_sales_amount",
    "unit_price",
    "product_name",
    "category",
    "cost",
    "first_name",
    "last_name",
    "country",
]

# Telemetry sections and audit tables.
SUMMARY = table(
    "last_dbt_run string, passed_tests long, failed_tests long, warning_tests long,"
    "avg_model_duration_sec double, total_models long, total_columns long,"
    "total_columns_with_tests long, overall_column_coverage_pct double, total_tests long,"
    "models_fully_covered long, models_well_covered long, models_poorly_covered long,"
    "overall_system_status string"
)
EXECUTION_LOGS = table(
    "execution_id string, run_timestamp timestamp, resource_type string, node_name string,"
    "target_table string, column_name string, status string, execution_time_seconds double,"
    "rows_affected long, error_message string"
)
MODEL_COVERAGE = table(
    "model_name string, schema string, total_columns long, columns_with_tests long,"
    "column_coverage_pct double, total_tests long"
)
COLUMN_COVERAGE = table(
    "model_name string, schema string, column_name string, column_description string,"
    "data_type string, test_count long, test_names string, has_tests boolean"
)
SOURCE_FRESHNESS = table(
    "source_table string, target_table string, last_loaded timestamp,"
    "hours_since_load long, minutes_since_load long"
)
NEWEST_LOADS = table("source_table string, target_table string, last_loaded timestamp")
INGESTION_LOGS = table(
    "log_id string, run_timestamp timestamp, resource_type string, table_name string,"
    "target_table string, source_rows long, destination_rows long, rows_inserted long,"
    "duration_seconds double, status string, error_message string"
)
TABLE_INGESTION_LOGS = table(
    "log_id string, run_timestamp timestamp, resource_type string, table_name string,"
    "target_table string, source_rows long, destination_rows long,"
    "duration_seconds double, status string, error_message string"
)
FRESHNESS_LOGS = table(
    "check_timestamp timestamp, dataset_name string, table_name string,"
    "last_modified_time timestamp, row_count long, size_bytes long,"
    "freshness_lag_minutes long, status string"
)
TEST_COVERAGE = table(
    "model_name string, schema string, database string, column_name string,"
    "column_description string, data_type string, test_count long, test_names string,"
    "has_tests boolean, model_total_columns long, model_columns_with_tests long,"
    "model_column_coverage_pct double, model_total_tests long, calculated_at timestamp"
)

# Audit table → (schema, day-partition column, clustering columns).
AUDIT_TABLES = {
    "dbt_execution_logs": (EXECUTION_LOGS, "run_timestamp", ["resource_type", "status"]),
    "ingestion_freshness_logs": (FRESHNESS_LOGS, "check_timestamp", ["dataset_name", "status"]),
    "table_ingestion_logs": (TABLE_INGESTION_LOGS, "run_timestamp", ["resource_type", "status"]),
    "dbt_test_coverage": (TEST_COVERAGE, "calculated_at", ["model_name", "schema"]),
}

TELEMETRY_SECTIONS = {
    "summary": SUMMARY,
    "execution_logs": EXECUTION_LOGS,
    "model_coverage": MODEL_COVERAGE,
    "column_coverage": COLUMN_COVERAGE,
    "source_freshness": SOURCE_FRESHNESS,
    "ingestion_logs": INGESTION_LOGS,
}
