"""Compose and store the telemetry of a run: six sections and a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright import schemas
from martwright.operators import telemetry
from martwright.session import cut_lineage
from martwright.sources import tables
from martwright.sources.files import path_exists, read_artifact, read_section, read_table


def telemetry_sections(
    results: DataFrame,
    nodes: DataFrame,
    sources: DataFrame,
    new_loads: DataFrame,
) -> dict[str, DataFrame]:
    """Section name → frame, from exploded results, nodes, sources and new loads.

    Most sections follow from the nodes and from the tests per column; both are stored first, so
    that they are computed once. Freshness is not among the sections: it follows from all stored
    loads (``store_sections``).
    """
    nodes = cut_lineage(nodes)
    tests = cut_lineage(telemetry.column_tests(nodes))
    models = telemetry.model_coverage(nodes, tests)
    found = {
        "summary": telemetry.health_summary(results, models),
        "execution_logs": telemetry.execution_logs(results, nodes, sources),
        "model_coverage": models,
        "column_coverage": telemetry.column_coverage(nodes, tests),
        "ingestion_logs": new_loads,
    }
    return {name: f.select(*schemas.TELEMETRY_SECTIONS[name].names) for name, f in found.items()}


def run_header(run_results: DataFrame) -> DataFrame:
    """Version, id, times and total seconds of a run artifact."""
    return run_results.select("metadata.*", "elapsed_time")


def _days(loads: DataFrame) -> list:
    """Days of some loads, a calendar's worth at most; NULL if one has no time."""
    return [row[0] for row in loads.select(F.to_date("run_timestamp")).distinct().collect()]


def merge_loads(spark: SparkSession, new: DataFrame, out: str) -> None:
    """Add loads to the stored history, and to the newest load of each target.

    The history is stored by day. Only the days of the new loads are read, merged and replaced;
    the newest loads are brought forward from the rows of these days alone.
    """
    new = cut_lineage(new.select(*schemas.INGESTION_LOGS.names))
    days = _days(new)
    if not days:
        return
    history = f"{out}/ingestion_logs"
    known = spark.createDataFrame([], schemas.INGESTION_LOGS)
    if path_exists(spark, history):
        stored = read_table(spark, history)
        day = F.col("_day") if "_day" in stored.columns else F.to_date("run_timestamp")
        wanted = day.isin([d for d in days if d is not None])
        if None in days:
            wanted = wanted | day.isNull()
        known = stored.filter(wanted).select(*schemas.INGESTION_LOGS.names)
    merged = cut_lineage(telemetry.merge_history(known, new))
    tables.replace_day(merged, history, "run_timestamp")
    newest = telemetry.source_freshness(merged).unionByName(newest_loads(spark, out))
    tables.refresh_table(telemetry.newest_per_target(newest), f"{out}/newest_loads")


def newest_loads(spark: SparkSession, out: str) -> DataFrame:
    """Newest successful load of every target, as stored."""
    return read_section(spark, f"{out}/newest_loads", schemas.NEWEST_LOADS)


def store_sections(
    spark: SparkSession, sections: dict[str, DataFrame], out: str, as_of=None
) -> dict[str, DataFrame]:
    """Store the sections of a run and return them as stored.

    The section of loads is merged into the stored history (``merge_loads``), and freshness
    follows from the newest stored loads; the others are replaced.
    """
    merge_loads(spark, sections["ingestion_logs"], out)
    aged = telemetry.freshness_age(newest_loads(spark, out), as_of)
    replaced = {name: frame for name, frame in sections.items() if name != "ingestion_logs"}
    replaced["source_freshness"] = aged.select(*schemas.SOURCE_FRESHNESS.names)
    tables.write_telemetry(replaced, out)
    declared = {**{name: frame.schema for name, frame in replaced.items()}, **schemas.TELEMETRY_SECTIONS}
    return {
        name: read_section(spark, f"{out}/{name}", declared[name])
        for name in [*sections, "source_freshness"]
    }


def stored_loads(spark: SparkSession, out: str) -> DataFrame:
    return read_section(spark, f"{out}/ingestion_logs", schemas.INGESTION_LOGS)


def export_telemetry(
    spark: SparkSession, run_results: str, manifest: str, load_manifest: str, out: str, as_of=None
) -> dict[str, DataFrame]:
    """Three JSON artifacts → stored sections plus the run header."""
    run = read_artifact(spark, run_results, telemetry.RUN_RESULTS)
    graph = read_artifact(spark, manifest, telemetry.MANIFEST)
    loads = telemetry.ingestion_rows(read_artifact(spark, load_manifest, telemetry.LOAD_MANIFEST))
    sections = telemetry_sections(
        telemetry.result_rows(run),
        telemetry.manifest_nodes(graph),
        telemetry.manifest_sources(graph),
        loads,
    )
    return store_sections(spark, {**sections, "header": run_header(run)}, out, as_of)
