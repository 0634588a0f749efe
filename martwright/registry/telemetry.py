"""Telemetry and observability operators (T)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions.redaction import mask_map, redact_text
from martwright.operators import artifacts, telemetry
from martwright.plans.telemetry_export import merge_loads, newest_loads
from martwright.registry import Catalog, r
from martwright.session import cut_lineage, scratch_path

QUERIES = Catalog()

AS_OF = "2024-01-30 12:00:00"
COLUMN_TYPE = "map<string, struct<name: string, description: string, data_type: string>>"


def nodes(t):
    """Manifest nodes: one model per part, one test per order line."""
    numbers = F.sequence(F.lit(1), F.col("declared_columns").cast("int"))
    entries = F.transform(
        numbers,
        lambda i: F.struct(
            F.concat(F.lit("c"), i.cast("string")).alias("key"),
            F.struct(
                F.concat(F.lit("c"), i.cast("string")).alias("name"),
                F.concat(F.lit("column "), i.cast("string")).alias("description"),
                F.lit("VARCHAR").alias("data_type"),
            ).alias("value"),
        ),
    )
    text = F.lit(None).cast("string")
    models = t.node_models.select(
        "unique_id",
        F.lit("model").alias("resource_type"),
        "name",
        "alias",
        "schema",
        "database",
        F.when(F.col("declared_columns") > 0, F.map_from_entries(entries))
        .otherwise(F.create_map().cast(COLUMN_TYPE))
        .alias("columns"),
        text.alias("attached_node"),
        text.alias("column_name"),
        text.alias("test_model"),
    )
    tests = t.node_tests.select(
        "unique_id",
        F.lit("test").alias("resource_type"),
        "name",
        text.alias("alias"),
        text.alias("schema"),
        text.alias("database"),
        F.create_map().cast(COLUMN_TYPE).alias("columns"),
        "attached_node",
        "column_name",
        "test_model",
    )
    return models.unionByName(tests)


LOGS_SQL = """
SELECT invocation_id AS execution_id, cast(replace(left(generated_at, 19), 'T', ' ') AS timestamp)
           AS run_timestamp,
       split_part(unique_id, '.', 1) AS resource_type, split_part(unique_id, '.', 3) AS node_name,
       split_part(unique_id, '.', 3) AS target_table,
       CASE WHEN starts_with(unique_id, 'test.')
                 AND len(string_split(split_part(unique_id, '.', 3), '_')) >= 3
            THEN string_split(split_part(unique_id, '.', 3), '_')[-1] END AS column_name,
       status, cast(round_even(coalesce(execution_time, 0), 2) AS double) AS execution_time_seconds,
       coalesce(failures, 0) AS rows_affected, message AS error_message
FROM run_results"""


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


@QUERIES.add(
    "t01_flatten_results",
    f"SELECT * REPLACE ({stamp('run_timestamp')} AS run_timestamp) FROM ({LOGS_SQL})",
    ("run_results",),
)
def _(t):
    return telemetry.flatten_results(t.run_results)


SOURCE_REL = (
    "CASE WHEN s.schema IS NOT NULL THEN concat(s.schema, '.', coalesce(s.identifier, s.name)) END"
)
MODEL_REL = "concat(m.schema, '.', coalesce(m.alias, m.name))"


EXECUTION_SQL = f"""
SELECT x.invocation_id AS execution_id, '1999-01-01 00:00:23' AS run_timestamp,
       split_part(x.unique_id, '.', 1) AS resource_type, split_part(x.unique_id, '.', 3) AS node_name,
       CASE WHEN own.unique_id IS NOT NULL THEN concat(own.schema, '.', coalesce(own.alias, own.name))
            WHEN n.attached_node IS NULL THEN {SOURCE_REL}
            WHEN m.unique_id IS NOT NULL THEN {MODEL_REL}
            ELSE CASE WHEN a.schema IS NOT NULL
                      THEN concat(a.schema, '.', coalesce(a.identifier, a.name)) END END
           AS target_table,
       coalesce(n.column_name, CASE WHEN starts_with(x.unique_id, 'test.')
            THEN string_split(split_part(x.unique_id, '.', 3), '_')[-1] END) AS column_name,
       x.status, cast(round_even(cast(coalesce(x.execution_time, 0) AS decimal(38, 10)), 2) AS double)
           AS execution_time_seconds,
       coalesce(x.failures, 0) AS rows_affected, x.message AS error_message
FROM test_results x
LEFT JOIN node_models own ON x.unique_id = own.unique_id
LEFT JOIN node_tests n ON x.unique_id = n.unique_id
LEFT JOIN node_models m ON n.attached_node = m.unique_id
LEFT JOIN node_sources a ON n.attached_node = a.unique_id
LEFT JOIN node_sources s ON n.attached_node IS NULL
     AND s.name = regexp_extract(n.test_model, 'source\\(''([^'']+)'',\\s*''([^'']+)''\\)', 2)"""
EXECUTION_TABLES = ("test_results", "node_models", "node_tests", "node_sources")


@QUERIES.add("t02_execution_logs", EXECUTION_SQL, EXECUTION_TABLES)
def _(t):
    return telemetry.execution_logs(t.test_results, nodes(t), t.node_sources)


@QUERIES.add(
    "t03_source_target",
    f"""
SELECT n.unique_id, {SOURCE_REL} AS target_table
FROM node_tests n JOIN node_sources s
  ON s.name = regexp_extract(n.test_model, 'source\\(''([^'']+)'',\\s*''([^'']+)''\\)', 2)
WHERE n.attached_node IS NULL""",
    ("node_tests", "node_sources"),
)
def _(t):
    return telemetry.source_target(nodes(t), t.node_sources)


def even(expression: str, places: int = 2) -> str:
    return f"cast(round_even(cast({expression} AS decimal(38, 10)), {places}) AS double)"


COVERAGE_CTES = f"""
WITH tested AS (
    SELECT attached_node, count(DISTINCT column_name) AS columns_with_tests,
           count(DISTINCT concat(column_name, '|', name)) AS total_tests
    FROM node_tests WHERE column_name IS NOT NULL GROUP BY 1),
mc AS (
    SELECT unique_id, name AS model_name, schema, database,
           cast(declared_columns AS bigint) AS total_columns,
           coalesce(columns_with_tests, 0) AS columns_with_tests,
           declared_columns - coalesce(columns_with_tests, 0) AS columns_without_tests,
           {even('coalesce(columns_with_tests, 0) / declared_columns * 100')} AS column_coverage_pct,
           coalesce(total_tests, 0) AS total_tests,
           {even('coalesce(total_tests, 0) / declared_columns')} AS avg_tests_per_column
    FROM node_models LEFT JOIN tested ON attached_node = unique_id WHERE declared_columns > 0),
declared AS (
    SELECT unique_id, name AS model_name, schema, database, unnest(range(1, declared_columns + 1)) AS i
    FROM node_models),
names AS (
    SELECT attached_node, column_name, count(DISTINCT name) AS test_count,
           string_agg(DISTINCT name, ',' ORDER BY name) AS test_names
    FROM node_tests WHERE column_name IS NOT NULL GROUP BY 1, 2),
cc AS (
    SELECT unique_id, model_name, schema, database, concat('c', cast(i AS varchar)) AS column_name,
           concat('column ', cast(i AS varchar)) AS column_description, 'VARCHAR' AS data_type,
           coalesce(test_count, 0) AS test_count, coalesce(test_names, '') AS test_names,
           test_count IS NOT NULL AS has_tests
    FROM declared LEFT JOIN names
      ON attached_node = unique_id AND names.column_name = concat('c', cast(i AS varchar)))
"""
NODES = ("node_models", "node_tests")


@QUERIES.add("t04_model_coverage", COVERAGE_CTES + "SELECT * FROM mc", NODES)
def _(t):
    return telemetry.model_coverage(nodes(t))


@QUERIES.add("t05_column_coverage", COVERAGE_CTES + "SELECT * FROM cc", NODES)
def _(t):
    return telemetry.column_coverage(nodes(t))


def result_artifacts(results):
    """Each result as a run artifact of its own, as text, with a field that nothing declares."""
    one = F.struct("unique_id", "status", "execution_time", "failures", "message", F.lit("x").alias("thread"))
    started = "invocation_started_at" if "invocation_started_at" in results.columns else "generated_at"
    header = F.struct("invocation_id", F.col(started).alias("invocation_started_at"), "generated_at")
    text = F.to_json(F.struct(header.alias("metadata"), F.array(one).alias("results")))
    return artifacts.as_variant(results.select(text.alias("value")))


def node_artifacts(t):
    """Each node as a manifest of its own, as text."""
    kwargs = F.struct(F.struct(F.col("test_model").alias("model")).alias("kwargs")).alias("test_metadata")
    names = ["resource_type", "name", "alias", "schema", "database", "columns", "attached_node", "column_name"]
    node = F.struct(*names, kwargs, F.array(F.lit(1)).alias("depends_on"))
    text = F.to_json(F.struct(F.create_map("unique_id", node).alias("nodes")))
    return artifacts.as_variant(nodes(t).select(text.alias("value")))


def parsed_nodes(t):
    """The nodes of the manifests, parsed once and stored for all that reads them."""
    return cut_lineage(artifacts.manifest_nodes(node_artifacts(t)))


def source_artifacts(t):
    source = F.struct("source_name", "name", "identifier", "schema")
    text = F.to_json(F.struct(F.create_map("unique_id", source).alias("sources")))
    return artifacts.as_variant(t.node_sources.select(text.alias("value")))


@QUERIES.add(
    "t01_flatten_results_variant",
    f"SELECT * REPLACE ({stamp('run_timestamp')} AS run_timestamp) FROM ({LOGS_SQL})",
    ("run_results",),
)
def _(t):
    return telemetry.flatten_results(artifacts.result_rows(result_artifacts(t.run_results)))


@QUERIES.add("t02_execution_logs_variant", EXECUTION_SQL, EXECUTION_TABLES)
def _(t):
    results = artifacts.result_rows(result_artifacts(t.test_results))
    sources = artifacts.manifest_sources(source_artifacts(t))
    return telemetry.execution_logs(results, parsed_nodes(t), sources)


@QUERIES.add(
    "t03_source_target_variant",
    f"""
SELECT n.unique_id, {SOURCE_REL} AS target_table
FROM node_tests n JOIN node_sources s
  ON s.name = regexp_extract(n.test_model, 'source\\(''([^'']+)'',\\s*''([^'']+)''\\)', 2)
WHERE n.attached_node IS NULL""",
    ("node_tests", "node_sources"),
)
def _(t):
    sources = artifacts.manifest_sources(source_artifacts(t))
    return telemetry.source_target(parsed_nodes(t), sources)


@QUERIES.add("t04_model_coverage_variant", COVERAGE_CTES + "SELECT * FROM mc", NODES)
def _(t):
    return telemetry.model_coverage(parsed_nodes(t))


@QUERIES.add("t05_column_coverage_variant", COVERAGE_CTES + "SELECT * FROM cc", NODES)
def _(t):
    return telemetry.column_coverage(parsed_nodes(t))


FLAT_SQL = """
SELECT cc.* EXCLUDE (unique_id), total_columns AS model_total_columns,
       columns_with_tests AS model_columns_with_tests,
       column_coverage_pct AS model_column_coverage_pct, total_tests AS model_total_tests,
       '2026-01-02 00:00:00' AS calculated_at
FROM cc JOIN mc ON cc.unique_id = mc.unique_id"""


def flat(t, as_of="2026-01-02"):
    n = nodes(t)
    tests = cut_lineage(telemetry.column_tests(n))
    return telemetry.coverage_flat(
        telemetry.model_coverage(n, tests), telemetry.column_coverage(n, tests), as_of
    )


@QUERIES.add("t06_coverage_flat", COVERAGE_CTES + FLAT_SQL, NODES)
def _(t):
    return flat(t)


@QUERIES.add(
    "t07_coverage_grade",
    COVERAGE_CTES
    + f"""
SELECT model_name, total_columns, columns_with_tests, column_coverage_pct, total_tests,
       CASE WHEN column_coverage_pct = 100 THEN 'OK' WHEN column_coverage_pct >= 50 THEN 'WARN'
            ELSE 'FAIL' END AS grade,
       {even('(SELECT sum(columns_with_tests) / sum(total_columns) * 100 FROM mc)')}
           AS overall_coverage_pct
FROM mc""",
    NODES,
)
def _(t):
    return telemetry.coverage_grade(telemetry.model_coverage(nodes(t)))


def totals_sql(full: str, overall: str) -> str:
    return f"""
SELECT count(*) AS total_models, cast(sum(total_columns) AS bigint) AS total_columns,
       cast(sum(columns_with_tests) AS bigint) AS total_columns_with_tests,
       {overall} AS overall_column_coverage_pct,
       cast(sum(total_tests) AS bigint) AS total_tests,
       count(*) FILTER (column_coverage_pct {full}) AS models_fully_covered,
       count(*) FILTER (column_coverage_pct >= 80) AS models_well_covered,
       count(*) FILTER (column_coverage_pct < 50) AS models_poorly_covered"""


RATIO_SQL = "sum(columns_with_tests) / sum(total_columns) * 100"
TOTALS_SQL = totals_sql(">= 100", even(RATIO_SQL))
NEWEST_TOTALS_SQL = totals_sql("= 100", f"round({RATIO_SQL}, 2)")


HEALTH_SQL = (
    COVERAGE_CTES
    + f""",
c AS ({TOTALS_SQL} FROM mc),
x AS (SELECT max(coalesce(invocation_started_at, generated_at)) AS last_dbt_run,
             count(*) FILTER (starts_with(unique_id, 'test.') AND status = 'pass') AS passed_tests,
             count(*) FILTER (starts_with(unique_id, 'test.') AND status IN ('fail', 'error'))
                 AS failed_tests,
             count(*) FILTER (starts_with(unique_id, 'test.') AND status = 'warn')
                 AS warning_tests,
             {even('avg(coalesce(execution_time, 0))', 4)} AS avg_model_duration_sec
      FROM test_results)
SELECT x.*, c.*, 'CRITICAL' AS overall_system_status FROM x, c"""
)


@QUERIES.add("t08_health_summary", HEALTH_SQL, (*NODES, "test_results"))
def _(t):
    return telemetry.health_summary(t.test_results, telemetry.model_coverage(nodes(t)))


@QUERIES.add(
    "t09_latest_health",
    COVERAGE_CTES
    + f""",
flat AS ({FLAT_SQL}),
pm AS (SELECT model_name, schema, max(model_total_columns) AS total_columns,
              max(model_columns_with_tests) AS columns_with_tests,
              max(model_column_coverage_pct) AS column_coverage_pct,
              max(model_total_tests) AS total_tests FROM flat GROUP BY 1, 2),
c AS ({NEWEST_TOTALS_SQL} FROM pm),
logs AS ({LOGS_SQL}),
x AS (SELECT {stamp('max(run_timestamp)')} AS last_dbt_run,
             count(*) FILTER (status IN ('pass', 'success')) AS passed_tests,
             count(*) FILTER (status IN ('fail', 'error')) AS failed_tests,
             count(*) FILTER (status = 'warn') AS warning_tests,
             {r('avg(execution_time_seconds)')} AS avg_model_duration_sec
      FROM logs WHERE execution_id = (SELECT arg_max(execution_id, run_timestamp) FROM logs))
SELECT x.*, c.*, CASE WHEN failed_tests > 0 THEN 'CRITICAL' WHEN warning_tests > 0 THEN 'WARNING'
                      WHEN overall_column_coverage_pct < 80 THEN 'WARNING' ELSE 'HEALTHY' END
                 AS overall_system_status FROM x, c""",
    (*NODES, "run_results"),
)
def _(t):
    # Snapshots are stored: the newest day is looked for first, then read.
    newest = cut_lineage(flat(t))
    # An older snapshot that must not count.
    older = newest.withColumns(
        {
            "calculated_at": F.lit("2026-01-01").cast("timestamp"),
            "model_name": F.concat(F.lit("old_"), "model_name"),
        }
    )
    return telemetry.latest_health(
        telemetry.flatten_results(t.run_results), newest.unionByName(older)
    )


@QUERIES.add(
    "t10_health_24h",
    f"""
WITH logs AS ({LOGS_SQL}),
x AS (SELECT {stamp('max(run_timestamp)')} AS last_dbt_run,
             count(*) FILTER (status = 'pass') AS passed_tests,
             count(*) FILTER (status IN ('fail', 'error')) AS failed_tests,
             count(*) FILTER (status = 'warn') AS warning_tests,
             {r('avg(execution_time_seconds)')} AS avg_model_duration_sec
      FROM logs WHERE run_timestamp >= timestamp '{AS_OF}' - INTERVAL 24 HOUR),
l AS (SELECT count(*) FILTER (status = 'STALE') AS stale_tables_count,
             max(freshness_lag_minutes) AS max_lag_minutes,
             {stamp('max(check_timestamp)')} AS last_ingestion_check
      FROM freshness_logs WHERE check_timestamp >= timestamp '{AS_OF}' - INTERVAL 24 HOUR)
SELECT x.*, l.*, CASE WHEN failed_tests > 0 OR stale_tables_count > 0 THEN 'CRITICAL'
                      WHEN warning_tests > 0 OR max_lag_minutes > 120 THEN 'WARNING'
                      ELSE 'HEALTHY' END AS overall_system_status FROM x, l""",
    ("run_results", "freshness_logs"),
)
def _(t):
    return telemetry.health_24h(
        telemetry.flatten_results(t.run_results), t.freshness_logs, AS_OF
    )


@QUERIES.add(
    "t11_ingestion_rows",
    """
SELECT concat(a, '-bronze.t', cast(user_id AS varchar), s) AS log_id,
       strftime(ts, '%Y-%m-%d 00:00:00') AS run_timestamp, 'csv_to_duckdb' AS resource_type,
       concat('f', cast(event_id AS varchar), s) AS table_name,
       concat('bronze.t', cast(user_id AS varchar), s) AS target_table,
       CASE s WHEN '_a' THEN event_id ELSE 0 END AS source_rows,
       event_id AS destination_rows, event_id AS rows_inserted, value AS duration_seconds,
       CASE s WHEN '_a' THEN 'success' ELSE 'unknown' END AS status,
       CASE s WHEN '_b' THEN event_type END AS error_message
FROM (SELECT *, strftime(ts, '%Y-%m-%dT00:00:00+00:00') AS a, unnest(['_a', '_b']) AS s FROM events)""",
)
def _(t):
    def entry(suffix, rows, status, error):
        return F.struct(
            F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(suffix)).alias(
                "source_file"
            ),
            F.concat(F.lit("bronze.t"), F.col("user_id").cast("string"), F.lit(suffix)).alias(
                "target_table"
            ),
            rows.alias("source_rows"),
            F.col("event_id").alias("destination_rows"),
            F.col("value").alias("duration_seconds"),
            status.alias("status"),
            error.alias("error_message"),
        )

    text = F.lit(None).cast("string")
    manifest = t.events.select(
        F.date_format("ts", "yyyy-MM-dd'T00:00:00+00:00'").alias("loaded_at"),
        F.array(
            entry("_a", F.col("event_id"), F.lit("success"), text),
            entry("_b", F.lit(None).cast("long"), text, F.col("event_type")),
        ).alias("tables"),
    )
    return telemetry.ingestion_rows(manifest)


@QUERIES.add(
    "t12_merge_history",
    """
WITH b AS (
    SELECT *, 0 AS src FROM ingestion_logs WHERE source_rows % 3 <> 0
    UNION ALL SELECT * REPLACE (concat('new-', log_id) AS log_id), 1 FROM ingestion_logs),
w AS (SELECT *, row_number() OVER (PARTITION BY run_timestamp, target_table ORDER BY src, log_id) AS n
      FROM b)
SELECT * EXCLUDE (src, n) REPLACE (strftime(run_timestamp, '%Y-%m-%d %H:%M:%S') AS run_timestamp)
FROM (SELECT * FROM w WHERE n = 1 ORDER BY w.run_timestamp DESC, target_table LIMIT 500)""",
    ("ingestion_logs",),
)
def _(t):
    old = t.ingestion_logs.filter("source_rows % 3 <> 0")
    new = t.ingestion_logs.withColumn("log_id", F.concat(F.lit("new-"), "log_id"))
    return telemetry.recent_history(telemetry.merge_history(old, new))


FRESH_SQL = """
SELECT arg_max(table_name, run_timestamp) AS source_table, target_table,
       max(run_timestamp) AS last_loaded
FROM ingestion_logs WHERE status IN ('pass', 'success') GROUP BY target_table"""


@QUERIES.add(
    "t13_source_freshness",
    f"SELECT * REPLACE ({stamp('last_loaded')} AS last_loaded) FROM ({FRESH_SQL})",
    ("ingestion_logs",),
)
def _(t):
    return telemetry.source_freshness(t.ingestion_logs)


@QUERIES.add(
    "t13_source_freshness_after_export",
    """
SELECT log_id || '-table' AS source_table, log_id AS target_table,
       strftime(run_timestamp, '%Y-%m-%d %H:%M:%S') AS last_loaded
FROM ingestion_logs WHERE status IN ('pass', 'success')""",
    ("ingestion_logs",),
)
def _(t):
    # One target for each load: more targets than a reader of the history sees.
    loads = t.ingestion_logs.withColumns(
        {"target_table": F.col("log_id"), "table_name": F.concat("log_id", F.lit("-table"))}
    )
    path = scratch_path(t.spark, "history")
    for part in ("source_rows % 3 <> 0", "source_rows % 3 = 0", "source_rows % 5 = 0"):
        merge_loads(t.spark, loads.filter(part), path)
    return newest_loads(t.spark, path)


AGED_SQL = f"""
SELECT source_table, target_table, {stamp('last_loaded')} AS last_loaded,
       cast(floor(epoch(timestamp '2024-02-05 07:31:10' - last_loaded) / 3600) AS bigint)
           AS hours_since_load,
       cast(floor(epoch(timestamp '2024-02-05 07:31:10' - last_loaded) / 60) AS bigint)
           AS minutes_since_load
FROM ({FRESH_SQL})"""


def aged(t):
    return telemetry.freshness_age(
        telemetry.source_freshness(t.ingestion_logs), "2024-02-05 07:31:10"
    )


@QUERIES.add("t14_freshness_age", AGED_SQL, ("ingestion_logs",))
def _(t):
    return aged(t)


@QUERIES.add(
    "t15_ingestion_history",
    f"""
SELECT * REPLACE ({stamp('run_timestamp')} AS run_timestamp) FROM (
    SELECT * FROM ingestion_logs
    WHERE run_timestamp >= timestamp '{AS_OF}' - INTERVAL 7 DAY
    ORDER BY ingestion_logs.run_timestamp DESC, log_id LIMIT 300)""",
    ("ingestion_logs",),
)
def _(t):
    return telemetry.ingestion_history(t.ingestion_logs, AS_OF, days_back=7, limit=300)


LATEST_SQL = """
SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY resource_type, table_name, target_table
                                 ORDER BY run_timestamp DESC, log_id DESC) AS n
    FROM ingestion_logs) WHERE n = 1"""


@QUERIES.add(
    "t16_latest_snapshot",
    f"SELECT * REPLACE ({stamp('run_timestamp')} AS run_timestamp) FROM ({LATEST_SQL})",
    ("ingestion_logs",),
)
def _(t):
    return telemetry.latest_snapshot(t.ingestion_logs)


@QUERIES.add(
    "t17_newest_logs",
    f"""
SELECT * REPLACE ({stamp('run_timestamp')} AS run_timestamp) FROM (
    SELECT * FROM ({LOGS_SQL}) AS logs
    ORDER BY logs.run_timestamp DESC, execution_id, resource_type, node_name, target_table,
             column_name NULLS FIRST, status, execution_time_seconds, rows_affected
    LIMIT 200)""",
    ("run_results",),
)
def _(t):
    return telemetry.newest_logs(telemetry.flatten_results(t.run_results))


@QUERIES.add(
    "t18_tested_counts",
    COVERAGE_CTES
    + """
SELECT model_name, has_tests, count(*) AS size,
       CASE WHEN has_tests THEN 'Tested Columns' ELSE 'Untested Columns' END AS status
FROM cc GROUP BY model_name, has_tests""",
    NODES,
)
def _(t):
    return telemetry.tested_counts(telemetry.column_coverage(nodes(t)))


@QUERIES.add(
    "t19_parity_unpivot",
    f"""
WITH l AS ({LATEST_SQL})
SELECT table_name, 'CSV (Source)' AS metric_type, source_rows AS row_count FROM l
UNION ALL SELECT table_name, 'DuckDB Bronze (Destination)', destination_rows FROM l""",
    ("ingestion_logs",),
)
def _(t):
    return telemetry.parity_unpivot(telemetry.latest_snapshot(t.ingestion_logs))


@QUERIES.add(
    "t20_health_kpis",
    COVERAGE_CTES
    + f""",
c AS ({TOTALS_SQL} FROM mc), f AS ({AGED_SQL})
SELECT (SELECT max(hours_since_load) FROM f) AS freshness_hours,
       (SELECT max(last_loaded) FROM f) AS latest_load, overall_column_coverage_pct, total_tests,
       CASE WHEN overall_column_coverage_pct >= 90 THEN 'success'
            WHEN overall_column_coverage_pct >= 70 THEN 'warning' ELSE 'danger' END
           AS coverage_band
FROM c""",
    (*NODES, "ingestion_logs"),
)
def _(t):
    summary = telemetry.health_summary(t.test_results, telemetry.model_coverage(nodes(t)))
    return telemetry.health_kpis(
        aged(t), summary.select("overall_column_coverage_pct", "total_tests")
    )


def stage_rows(t):
    kind = F.when(F.col("event_id") % 3 == 0, "start").when(F.col("event_id") % 3 == 1, "success")
    return t.events.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("load_"), "event_type").alias("script"),
        kind.otherwise("failure").alias("event"),
        F.create_map(
            F.lit("connection_string"),
            F.col("props"),
            F.lit("rows"),
            F.col("event_id").cast("string"),
            F.lit("error"),
            F.concat(F.lit("password=private"), F.col("event_id").cast("string"), F.lit("! failed")),
            F.lit("path"),
            F.concat(F.lit("see /data/raw/"), F.col("user_id").cast("string"), F.lit(".csv now")),
        ).alias("details"),
    )


@QUERIES.add(
    "t21_audit_events",
    """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, concat('load_', event_type) AS script,
       CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'success' ELSE 'failure' END AS event,
       '[REDACTED]' AS connection_string, cast(event_id AS varchar) AS rows,
       '[REDACTED]' AS error, 'see [PATH_REDACTED] now' AS path
FROM events""",
)
def _(t):
    clean = telemetry.audit_events(stage_rows(t))
    return clean.select(
        F.translate(F.substring("timestamp", 1, 19), "T", " ").alias("timestamp"),
        "script",
        "event",
        *[F.col("details")[k].alias(k) for k in ("connection_string", "rows", "error", "path")],
    )


@QUERIES.add(
    "t22_mask_map",
    """
SELECT c_custkey, c_name AS plain, '[REDACTED]' AS inner_token, '[REDACTED]' AS under_secret
FROM customer""",
)
def _(t):
    text = T.StringType()
    kind = T.MapType(text, T.MapType(text, text))
    nested = F.create_map(
        F.lit("outer"),
        F.create_map(F.lit("name"), F.col("c_name"), F.lit("Access_Token"), F.col("c_name")),
        F.lit("my_secrets"),
        F.create_map(F.lit("name"), F.col("c_name"), F.lit("other"), F.col("c_name")),
    )
    masked = t.customer.select("c_custkey", mask_map(nested, kind).alias("m"))
    return masked.select(
        "c_custkey",
        F.col("m")["outer"]["name"].alias("plain"),
        F.col("m")["outer"]["Access_Token"].alias("inner_token"),
        F.col("m")["my_secrets"]["other"].alias("under_secret"),
    )


@QUERIES.add(
    "t23_redact_text",
    r"""
WITH a AS (SELECT doc_id, regexp_replace(text,
        '(?i)(api[_-]?key|secret|token|password|passwd|pwd|credential)[:=]\s*["'']?([A-Za-z0-9_\-./+]{8,})',
        '\1=[REDACTED]', 'g') AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(x, '(?i)[a-z][a-z0-9+\-.]*://[^:@/\s]+:[^@/\s]+@',
        '[REDACTED]', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(x,
        '(?i)(driver|server|host|uid|user|pwd|password|database|db)=[^;"'']+(?:;|$)',
        '[REDACTED]', 'g') AS x FROM b),
e AS (SELECT doc_id, regexp_replace(x,
        '(?i)(?:SELECT|FROM|JOIN|WHERE|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)[^\n]{0,200}',
        '[SQL_REDACTED]', 'g') AS x FROM c)
SELECT doc_id, array_to_string(list_transform(
           regexp_extract_all(x, '[A-Za-z0-9_./-]+|[^A-Za-z0-9_./-]+'),
           lambda run: CASE WHEN regexp_full_match(run, '/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+')
                     THEN '[PATH_REDACTED]' ELSE run END), '') AS redacted
FROM e""",
)
def _(t):
    return t.documents.select("doc_id", redact_text("text").alias("redacted"))


