"""Table loads and copies over Parquet directories."""

from __future__ import annotations

import re
import time
from collections.abc import Collection

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright import schemas
from martwright.functions.columns import as_stamp
from martwright.sources.files import (
    current_version,
    discover_csvs,
    drop_other_versions,
    load_bronze_table,
    new_version,
    normalize_columns,
    path_exists,
    read_table,
    remove_path,
    scan_csv_text,
    switch_version,
    table_path,
)

LOAD_LOG = schemas.table(
    "table_name string, target_table string, source_file string, source_rows long,"
    "destination_rows long, duration_seconds double, status string, error_message string"
)
COPY_LOG = schemas.table("table_name string, rows_copied long, status string, error_message string")

# Surrogate keys are hex text, which this codec halves.
STORED = {"compression": "zstd"}

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def checked_name(name: str) -> str:
    """Table names are used in paths, so only plain identifiers pass."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a plain table name: {name!r}")
    return name


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet directory; answered from the file footers."""
    return read_table(spark, path).count() if path_exists(spark, path) else 0


def refresh_table(df: DataFrame, path: str) -> int:
    """Replace the rows of a table, so that a re-run does not duplicate them.

    Rows are written as a version folder of their own; then the marker that names the current
    version is replaced in one step. Whenever a refresh stops, ``read_table`` finds all old or all
    new rows, and the next refresh removes what it left. The version before stays until then,
    for readers that have begun with it; so the new rows may be computed from the old. One
    refresh of a table runs at a time.
    """
    spark, before = df.sparkSession, None
    if path_exists(spark, path):
        before = current_version(spark, path)
        drop_other_versions(spark, path, {before})
    version = new_version(path)
    try:
        df.write.options(**STORED).parquet(version)
    except Exception:
        remove_path(spark, version)
        raise
    switch_version(spark, path, version)
    if before is not None:
        drop_other_versions(spark, path, {before, current_version(spark, path)})
    return stored_rows(spark, path)


def append_rows(df: DataFrame, path: str) -> int:
    """Append; empty input writes nothing and returns 0.

    The commit protocol makes the files of a failed job invisible, so an append
    is all or nothing. The rows are observed as they are written.
    """
    if df.isEmpty():
        return 0
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(
        table_path(df.sparkSession, path)
    )
    return written.get["rows"]


def load_table(
    spark: SparkSession, path: str, schema: T.StructType, out: str, quoted_breaks: bool = True
) -> tuple[int, int]:
    """Load one file over a table: rows of its text scan, and rows the table then holds.

    A value that does not fit its type fails the load and leaves the table as it was. Without
    ``quoted_breaks`` a large file is read by several tasks.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no source file at {path}")
    # Scan and write form one narrow stage, so each row is observed once.
    scanned = Observation()
    text = scan_csv_text(spark, path, quoted_breaks).observe(scanned, F.count(F.lit(1)).alias("rows"))
    held = refresh_table(load_bronze_table(text, schema), out)
    return scanned.get["rows"], held


def load_bronze(
    spark: SparkSession,
    source: str,
    target: str,
    tables: dict | None = None,
    unbroken: Collection[str] = (),
) -> DataFrame:
    """Load every source file; a failing table is recorded and the others go on.

    ``unbroken`` names the tables whose files hold no line break inside a quoted field.
    """
    outcomes = []
    for name, (file, schema) in (tables or schemas.BRONZE).items():
        began, rows, problem = time.perf_counter(), (0, 0), None
        try:
            out = f"{target}/{checked_name(name)}"
            rows = load_table(spark, f"{source}/{file}", schema, out, name not in unbroken)
        except Exception as error:  # noqa: BLE001 - one table must not stop the batch
            problem = str(error).splitlines()[0]
        seconds = round(time.perf_counter() - began, 4)
        status = "success" if problem is None else "error"
        outcomes.append((name, f"bronze.{name}", file, *rows, seconds, status, problem))
    return spark.createDataFrame(outcomes, LOAD_LOG)


def load_failed(log: DataFrame) -> bool:
    """True when any table of a batch load did not succeed."""
    return not log.filter(F.col("status") != "success").isEmpty()


def append_csvs(
    spark: SparkSession, root: str, out: str, unbroken: Collection[str] = ()
) -> DataFrame:
    """Append every discovered CSV, headers stripped, to its table; ``unbroken`` as in ``load_bronze``."""
    rows = []
    for path, table in discover_csvs(spark, root):
        frame = normalize_columns(scan_csv_text(spark, path, table not in unbroken))
        rows.append((checked_name(table), append_rows(frame, f"{out}/{table}"), "success", None))
    return spark.createDataFrame(rows, COPY_LOG)


def replicate_tables(spark: SparkSession, source: str, target: str, tables: list[str]) -> DataFrame:
    """Copy tables, replacing the destination; each failure stays with its table."""
    rows = []
    for name in tables:
        try:
            checked_name(name)
            if not path_exists(spark, f"{source}/{name}"):
                raise FileNotFoundError(f"no such table: {name}")
            copied = refresh_table(read_table(spark, f"{source}/{name}"), f"{target}/{name}")
            rows.append((name, copied, "success", None))
        except Exception as error:  # noqa: BLE001
            rows.append((name, 0, "error", str(error).splitlines()[0]))
    return spark.createDataFrame(rows, COPY_LOG)


def export_gold(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Copy the gold tables to their own artifact, reporting row counts."""
    return replicate_tables(spark, source, out, schemas.GOLD_TABLES)


def replace_day(df: DataFrame, path: str, ts_col: str, day_col: str = "_day") -> None:
    """Replace only the days present in ``df``; other days stay.

    Dynamic partition overwrite swaps whole day partitions at commit, so the
    re-run of a day is safe. Rebalancing gathers the rows of a day into few files
    and splits a day that is too large for one task.
    """
    (
        df.withColumn(day_col, F.to_date(ts_col))
        .hint("rebalance", day_col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day_col)
        .parquet(path)
    )


def write_audit(df: DataFrame, path: str, table: str) -> None:
    """Append to an audit table: day partitions, rows clustered inside each file.

    Rebalancing by day splits a day that outgrows one task; clustering is then a
    sort within each part.
    """
    schema, ts_col, cluster = schemas.AUDIT_TABLES[table]
    shaped = df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    ).withColumn("_day", F.to_date(ts_col))
    (
        shaped.hint("rebalance", "_day")
        .sortWithinPartitions("_day", *cluster)
        .write.mode("append")
        .partitionBy("_day")
        .parquet(f"{path}/{table}")
    )


def append_execution_log(
    spark: SparkSession,
    path: str,
    execution_id: str,
    resource_type: str,
    node_name: str,
    target_table: str,
    status: str,
    duration_seconds: float,
    rows_affected: int,
    run_timestamp,
    error_message: str | None = None,
) -> None:
    """One execution-log row, the duration rounded to two places."""
    row = spark.range(1).select(
        F.lit(execution_id).alias("execution_id"),
        as_stamp(run_timestamp).alias("run_timestamp"),
        F.lit(resource_type).alias("resource_type"),
        F.lit(node_name).alias("node_name"),
        F.lit(target_table).alias("target_table"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit(status).alias("status"),
        F.lit(round(duration_seconds, 2)).alias("execution_time_seconds"),
        F.lit(rows_affected).cast("long").alias("rows_affected"),
        F.lit(error_message).cast("string").alias("error_message"),
    )
    write_audit(row, path, "dbt_execution_logs")


def ingestion_log_rows(log: DataFrame, run_timestamp, resource_type: str) -> DataFrame:
    """Load-log rows in audit shape; a missing error becomes empty text."""
    return log.select(
        F.expr("uuid()").alias("log_id"),
        as_stamp(run_timestamp).alias("run_timestamp"),
        F.lit(resource_type).alias("resource_type"),
        "table_name",
        "target_table",
        "source_rows",
        "destination_rows",
        "duration_seconds",
        "status",
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


def append_ingestion_log(log: DataFrame, path: str, run_timestamp, resource_type: str) -> None:
    write_audit(ingestion_log_rows(log, run_timestamp, resource_type), path, "table_ingestion_logs")


def materialize(
    layers: dict[str, dict[str, DataFrame]],
    out: str,
    views: tuple = ("silver",),
    sort: dict[str, list[str]] | None = None,
) -> dict:
    """Layer → table → frame: view layers become temp views, the others tables.

    ``sort`` orders the rows of a table inside each file, so that range filters
    on those columns can skip row groups; it costs no shuffle. Returns the frames
    to read from, in the same shape.
    """
    result: dict[str, dict[str, DataFrame]] = {}
    for layer, frames in layers.items():
        result[layer] = {}
        for name, frame in frames.items():
            if layer in views:
                frame.createOrReplaceTempView(f"{checked_name(layer)}_{checked_name(name)}")
                result[layer][name] = frame
            else:
                path = f"{out}/{checked_name(layer)}/{checked_name(name)}"
                if sort and name in sort:
                    frame = frame.sortWithinPartitions(*sort[name])
                refresh_table(frame, path)
                result[layer][name] = read_table(frame.sparkSession, path)
    return result


def write_telemetry(sections: dict[str, DataFrame], out: str) -> None:
    """One directory per section; every section is replaced."""
    for name, frame in sections.items():
        refresh_table(frame, f"{out}/{checked_name(name)}")
