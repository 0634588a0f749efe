"""Sources, sinks and loads (S), layer materialisation (G07) and CSV appends (N09).

Every query writes the given tables to a fresh directory below the shared one,
runs the load, and returns what was read back or the load's own log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright import schemas
from martwright.operators import gold
from martwright.plans.telemetry_export import store_sections, telemetry_sections
from martwright.registry import GOLD, Catalog, r, rounded
from martwright.registry.silver import SILVER
from martwright.registry.star import TIERS
from martwright.registry.telemetry import (
    AGED_SQL,
    COVERAGE_CTES,
    EXECUTION_SQL,
    EXECUTION_TABLES,
    HEALTH_SQL,
    NODES,
    nodes,
)
from martwright.session import scratch_path
from martwright.sources import files, tables

QUERIES = Catalog()


def write_csv(df: DataFrame, path: str) -> str:
    df.write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


def landing(t, names=SILVER) -> str:
    """Bronze shapes as CSV below their landing folders."""
    root = scratch_path(t.spark, "landing")
    for name in names:
        write_csv(getattr(t, name), f"{root}/{schemas.BRONZE[name][0]}")
    return root


def star_tables(t) -> dict[str, DataFrame]:
    return {
        "fct_sales": t.fct_sales,
        "dim_products": t.dim_products,
        "dim_customers": t.dim_customers,
    }


def mart_tables(star: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The mart over the stored star, so that the fact is composed once."""
    return {"product_360": gold.product_360(star["fct_sales"], star["dim_products"], TIERS)}


def stored_gold(t) -> str:
    root = scratch_path(t.spark, "gold")

    def store(frames):
        for name, frame in frames.items():
            frame.write.options(**tables.STORED).parquet(f"{root}/{name}")
        return {name: files.read_table(t.spark, f"{root}/{name}") for name in frames}

    store(mart_tables(store(star_tables(t))))
    return root


@QUERIES.add(
    "s01_scan_csv_text",
    """
SELECT cast(prd_id AS varchar) AS prd_id, prd_key, prd_nm, cast(prd_cost AS varchar) AS prd_cost,
       prd_line, prd_start_dt, prd_end_dt, concat(prd_key, chr(10), 'note') AS note
FROM crm_prd_info""",
    SILVER[1:2],
)
def _(t):
    noted = t.crm_prd_info.withColumn("note", F.concat("prd_key", F.lit("\nnote")))
    path = write_csv(noted, scratch_path(t.spark, "csv"))
    return files.scan_csv_text(t.spark, path)


@QUERIES.add(
    "s02_load_bronze_table",
    f"""
SELECT * REPLACE ({r('sls_price', 8)} AS sls_price) FROM crm_sales_details""",
    SILVER[2:3],
)
def _(t):
    path = write_csv(t.crm_sales_details, scratch_path(t.spark, "csv"))
    schema = schemas.BRONZE["crm_sales_details"][1]
    loaded = files.load_bronze_table(files.scan_csv_text(t.spark, path), schema)
    return rounded(loaded, 8, "sls_price")


COUNTS = "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, 'bronze.{name}' AS target_table,"
    f" '{schemas.BRONZE[name][0]}' AS source_file, (SELECT count(*) FROM {name}) AS source_rows,"
    f" (SELECT count(*) FROM {name}) AS destination_rows, 'success' AS status"
    for name in SILVER
)


@QUERIES.add(
    "s03_load_bronze",
    f"""
SELECT table_name,
       CASE WHEN table_name IN ('{SILVER[4]}', '{SILVER[5]}') THEN 'error' ELSE status END AS status,
       CASE WHEN table_name IN ('{SILVER[4]}', '{SILVER[5]}') THEN 0 ELSE source_rows END AS source_rows,
       CASE WHEN table_name = '{SILVER[5]}' THEN 0 ELSE destination_rows END AS stored
FROM ({COUNTS})""",
    SILVER,
)
def _(t):
    # Second load over held tables: one file got a wrong shape, one is missing from the start.
    spark, out = t.spark, scratch_path(t.spark, "bronze")
    root = landing(t, SILVER[:-1])
    tables.load_bronze(spark, root, out)
    wrong = f"{root}/{schemas.BRONZE[SILVER[4]][0]}"
    getattr(t, SILVER[4]).withColumn("more", F.lit("x")).write.mode("overwrite").csv(wrong, header=True)
    log = tables.load_bronze(spark, root, out)
    held = [(name, tables.stored_rows(spark, f"{out}/{name}")) for name in SILVER]
    stored = spark.createDataFrame(held, "table_name string, stored long")
    return log.select("table_name", "status", "source_rows").join(stored, "table_name")


@QUERIES.add(
    "s04_row_parity",
    "SELECT table_name, source_rows, destination_rows, source_rows = destination_rows AS matches"
    f" FROM ({COUNTS})",
    SILVER,
)
def _(t):
    # The shapes hold no line breaks: their files may be split.
    out = scratch_path(t.spark, "bronze")
    log = tables.load_bronze(t.spark, landing(t), out, unbroken=SILVER)
    return log.select(
        "table_name",
        "source_rows",
        "destination_rows",
        (F.col("source_rows") == F.col("destination_rows")).alias("matches"),
    )


@QUERIES.add(
    "s05_discover_csvs",
    f"""
SELECT table_name, source_rows AS row_count FROM ({COUNTS})
UNION ALL SELECT 'extra_part', count(*) FROM part""",
    SILVER,
)
def _(t):
    root = landing(t)
    padded = t.part.toDF(*[f" {c.upper()} " for c in t.part.columns])
    write_csv(padded, f"{root}/extra/Part.csv")
    found = [
        files.normalize_columns(files.scan_csv_text(t.spark, path, quoted_breaks=False))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(table).alias("table_name"), "row_count")
        for path, table in files.discover_csvs(t.spark, root)
    ]
    result = found[0]
    for frame in found[1:]:
        result = result.unionByName(frame)
    return result


@QUERIES.add("s06_refresh_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    path = scratch_path(t.spark, "refresh")
    frame = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    for _ in range(2):
        tables.refresh_table(frame, path)
    return files.read_table(t.spark, path)


@QUERIES.add("s06_refresh_table_failed", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    path = scratch_path(t.spark, "refresh")
    frame = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    tables.refresh_table(frame, path)
    broken = frame.withColumn("s_acctbal", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN raise_error('bad') END"))
    try:
        tables.refresh_table(broken, path)
    except SparkRuntimeException:
        return files.read_table(t.spark, path)
    raise AssertionError("the second refresh must fail")


@QUERIES.add(
    "s07_append_rows",
    """
SELECT 'first' AS load, count(*) AS inserted, (SELECT 2 * count(*) FROM customer) AS stored
FROM customer
UNION ALL SELECT 'second', count(*), (SELECT 2 * count(*) FROM customer) FROM customer
UNION ALL SELECT 'empty', 0, (SELECT 2 * count(*) FROM customer)""",
)
def _(t):
    path = scratch_path(t.spark, "append")
    inserted = [
        ("first", tables.append_rows(t.customer, path)),
        ("second", tables.append_rows(t.customer, path)),
        ("empty", tables.append_rows(t.customer.limit(0), path)),
    ]
    stored = tables.stored_rows(t.spark, path)
    return t.spark.createDataFrame(
        [(*row, stored) for row in inserted], "load string, inserted long, stored long"
    )


@QUERIES.add(
    "s08_replicate_tables",
    """
SELECT 'fct_sales' AS table_name, count(*) AS rows_copied, 'success' AS status FROM fct_sales
UNION ALL SELECT 'dim_products', count(*), 'success' FROM dim_products
UNION ALL SELECT 'dim_customers', count(*), 'success' FROM dim_customers
UNION ALL SELECT 'product_360', count(DISTINCT f.product_key), 'success'
          FROM fct_sales f JOIN dim_products p ON f.product_key = p.product_key
UNION ALL SELECT 'no_such_table', 0, 'error'
UNION ALL SELECT 'bad name; --', 0, 'error'""",
    GOLD,
)
def _(t):
    listed = ["fct_sales", "no_such_table", "bad name; --", "dim_products", "dim_customers", "product_360"]
    log = tables.replicate_tables(t.spark, stored_gold(t), scratch_path(t.spark, "copy"), listed)
    return log.drop("error_message")


@QUERIES.add(
    "s09_export_gold",
    """
SELECT 'fct_sales' AS table_name, count(*) AS rows_copied, 'success' AS status FROM fct_sales
UNION ALL SELECT 'dim_products', count(*), 'success' FROM dim_products
UNION ALL SELECT 'dim_customers', count(*), 'success' FROM dim_customers
UNION ALL SELECT 'product_360', count(DISTINCT f.product_key), 'success'
          FROM fct_sales f JOIN dim_products p ON f.product_key = p.product_key""",
    GOLD,
)
def _(t):
    out = scratch_path(t.spark, "export")
    return tables.export_gold(t.spark, stored_gold(t), out).drop("error_message")


@QUERIES.add(
    "s12_replace_day",
    """
SELECT event_id, CASE WHEN day(ts) % 2 = 0 THEN -value ELSE value END AS value,
       strftime(ts, '%Y-%m-%d') AS day
FROM events""",
)
def _(t):
    path = scratch_path(t.spark, "days")
    events = t.events.select("event_id", "ts", "value")
    tables.replace_day(events, path, "ts")
    again = events.filter(F.day("ts") % 2 == 0).withColumn("value", -F.col("value"))
    for _ in range(2):
        tables.replace_day(again, path, "ts")
    return t.spark.read.parquet(path).select("event_id", "value", F.col("_day").alias("day"))


AUDIT_SQL = """
SELECT log_id, strftime(run_timestamp, '%Y-%m-%d %H:%M:%S') AS run_timestamp, resource_type,
       table_name, target_table, source_rows, destination_rows, duration_seconds, status,
       {0} AS error_message
FROM ingestion_logs"""


@QUERIES.add("s13_write_audit", AUDIT_SQL.format("error_message"), ("ingestion_logs",))
def _(t):
    path = scratch_path(t.spark, "audit")
    tables.write_audit(t.ingestion_logs, path, "table_ingestion_logs")
    return t.spark.read.parquet(f"{path}/table_ingestion_logs").drop("_day")


@QUERIES.add(
    "s14_parse_artifact",
    """
SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events""",
)
def _(t):
    parsed = files.parse_artifact(t.events, "props", "k bigint")
    return parsed.select("event_id", "artifact.k")


SECTION_SQL = """
SELECT log_id, strftime(run_timestamp, '%Y-%m-%d %H:%M:%S') AS run_timestamp, resource_type,
       table_name, target_table, source_rows, destination_rows, rows_inserted, duration_seconds,
       status, error_message
FROM ingestion_logs"""


@QUERIES.add("s15_write_telemetry", SECTION_SQL, ("ingestion_logs",))
def _(t):
    out = scratch_path(t.spark, "telemetry")
    for _ in range(2):
        tables.write_telemetry({"ingestion_logs": t.ingestion_logs}, out)
    return files.read_table(t.spark, f"{out}/ingestion_logs").select(*schemas.INGESTION_LOGS.names)


def stored_section(t, name: str) -> DataFrame:
    """All sections of a run are composed and stored; one is read back."""
    out = scratch_path(t.spark, "telemetry")
    sections = telemetry_sections(
        t.test_results,
        nodes(t),
        t.node_sources,
        t.ingestion_logs,
    )
    return store_sections(t.spark, sections, out, "2024-02-05 07:31:10")[name]


MODEL_SECTION = "model_name, schema, total_columns, columns_with_tests, column_coverage_pct, total_tests"
COLUMN_SECTION = (
    "model_name, schema, column_name, column_description, data_type, test_count, test_names, has_tests"
)
# Of loads of one target at one time the smallest log_id stays.
HISTORY_SQL = f"""
SELECT * FROM ({SECTION_SQL})
QUALIFY row_number() OVER (PARTITION BY run_timestamp, target_table ORDER BY log_id) = 1"""


@QUERIES.add("s15_write_telemetry_sections", HEALTH_SQL, (*NODES, "test_results"))
def _(t):
    return stored_section(t, "summary")


@QUERIES.add("s15_section_execution_logs", EXECUTION_SQL, EXECUTION_TABLES)
def _(t):
    return stored_section(t, "execution_logs")


@QUERIES.add("s15_section_model_coverage", COVERAGE_CTES + f"SELECT {MODEL_SECTION} FROM mc", NODES)
def _(t):
    return stored_section(t, "model_coverage")


@QUERIES.add("s15_section_column_coverage", COVERAGE_CTES + f"SELECT {COLUMN_SECTION} FROM cc", NODES)
def _(t):
    return stored_section(t, "column_coverage")


@QUERIES.add("s15_section_source_freshness", AGED_SQL, ("ingestion_logs",))
def _(t):
    return stored_section(t, "source_freshness")


@QUERIES.add("s15_section_ingestion_logs", HISTORY_SQL, ("ingestion_logs",))
def _(t):
    return stored_section(t, "ingestion_logs")


@QUERIES.add(
    "s16_read_section",
    f"""
SELECT * REPLACE (cast(NULL AS varchar) AS error_message) FROM ({SECTION_SQL})""",
    ("ingestion_logs",),
)
def _(t):
    # Stored in another order and without one column; a second section is absent.
    out = scratch_path(t.spark, "telemetry")
    kept = [c for c in reversed(t.ingestion_logs.columns) if c != "error_message"]
    tables.write_telemetry({"ingestion_logs": t.ingestion_logs.select(*kept)}, out)
    found = files.read_section(t.spark, f"{out}/ingestion_logs", schemas.INGESTION_LOGS)
    absent = files.read_section(t.spark, f"{out}/absent", schemas.INGESTION_LOGS)
    return found.unionByName(absent)


@QUERIES.add(
    "s19_append_ingestion_log",
    """
SELECT '2026-01-01 00:00:00' AS run_timestamp, 'csv_load' AS resource_type, table_name,
       target_table, source_rows, destination_rows, duration_seconds, status,
       coalesce(error_message, '') AS error_message
FROM ingestion_logs""",
    ("ingestion_logs",),
)
def _(t):
    path = scratch_path(t.spark, "audit")
    tables.append_ingestion_log(t.ingestion_logs, path, "2026-01-01", "csv_load")
    return t.spark.read.parquet(f"{path}/table_ingestion_logs").drop("_day", "log_id")


@QUERIES.add(
    "s19_append_execution_log",
    """
SELECT 'run-1' AS execution_id, '2026-01-01 00:00:00' AS run_timestamp,
       'csv_ingestion' AS resource_type, 'part.csv' AS node_name, 'bronze.part' AS target_table,
       cast(NULL AS varchar) AS column_name, 'pass' AS status,
       cast(1.23 AS double) AS execution_time_seconds,
       count(*) AS rows_affected, cast(NULL AS varchar) AS error_message
FROM part""",
)
def _(t):
    path = scratch_path(t.spark, "audit")
    loaded = tables.refresh_table(t.part, scratch_path(t.spark, "part"))
    tables.append_execution_log(
        t.spark,
        path,
        "run-1",
        "csv_ingestion",
        "part.csv",
        "bronze.part",
        "pass",
        1.2345,
        loaded,
        "2026-01-01",
    )
    return t.spark.read.parquet(f"{path}/dbt_execution_logs").drop("_day")


@QUERIES.add(
    "g07_materialize",
    f"""
SELECT 'silver' AS layer, table_name, source_rows AS row_count FROM ({COUNTS})
UNION ALL SELECT 'gold', 'fct_sales', count(*) FROM fct_sales
UNION ALL SELECT 'gold', 'dim_products', count(*) FROM dim_products
UNION ALL SELECT 'gold', 'dim_customers', count(*) FROM dim_customers
UNION ALL SELECT 'gold', 'product_360', count(DISTINCT f.product_key)
          FROM fct_sales f JOIN dim_products p ON f.product_key = p.product_key""",
    (*GOLD, *SILVER),
)
def _(t):
    out = scratch_path(t.spark, "layers")
    silver = {name: getattr(t, name) for name in SILVER}
    built = tables.materialize({"silver": silver, "gold": star_tables(t)}, out)
    marts = tables.materialize({"gold": mart_tables(built["gold"])}, out)
    built["gold"] |= marts["gold"]
    counts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), "row_count"
        )
        for layer, frames in built.items()
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@QUERIES.add(
    "n09_append_csvs",
    f"SELECT table_name, source_rows AS rows_copied, 2 * source_rows AS stored FROM ({COUNTS})",
    SILVER,
)
def _(t):
    root, out = landing(t), scratch_path(t.spark, "bronze")
    tables.append_csvs(t.spark, root, out, SILVER)
    log = tables.append_csvs(t.spark, root, out, SILVER)
    stored = [
        t.spark.read.parquet(f"{out}/{name}")
        .agg(F.count(F.lit(1)).alias("stored"))
        .withColumn("table_name", F.lit(name))
        for name in SILVER
    ]
    return log.select("table_name", "rows_copied").join(
        reduce(DataFrame.unionByName, stored), "table_name"
    )



