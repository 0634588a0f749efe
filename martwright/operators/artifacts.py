"""Run and manifest artifacts read as VARIANT: no fixed shape, whatever fields they gain or change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS_TYPE = "map<string, struct<name: string, description: string, data_type: string>>"
_NODE = (
    "struct<resource_type: string, name: string, alias: string, schema: string, database: string,"
    f" columns: {COLUMNS_TYPE}, attached_node: string, column_name: string,"
    " test_metadata: struct<kwargs: struct<model: string>>>"
)
_SOURCE_TEXTS = ("source_name", "name", "identifier", "schema", "database")
_HEADER_TEXTS = ("invocation_started_at", "generated_at")


def as_variant(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts as one VARIANT column ``artifact``; NULL where a text is no JSON object."""
    # JSON that parses and opens with a brace is an object; no second parse has to tell.
    is_object = F.ltrim(F.col(column), F.lit(" \t\r\n")).startswith("{")
    return texts.select(F.when(is_object, F.try_parse_json(column)).alias("artifact"))


def _get(value: str, path: str, kind: str = "string") -> Column:
    """A field in the type asked for; NULL where it is absent or does not fit."""
    return F.try_variant_get(value, path, kind)


def entries(artifacts: DataFrame, path: str, *kept: Column) -> DataFrame:
    """``key, value`` of the object or array at a path, a row each; ``kept`` columns stay beside."""
    held = artifacts.select(*kept, F.try_variant_get("artifact", path, "variant").alias("_held"))
    exploded = held.sparkSession.tvf.variant_explode(F.col("_held").outer())
    return held.lateralJoin(exploded).drop("_held", "pos")


def manifest_nodes(artifacts: DataFrame) -> DataFrame:
    """One row per node of the manifests, as ``telemetry.manifest_nodes`` gives them."""
    # All fields by one path: one that does not fit is NULL alone.
    nodes = entries(artifacts, "$.nodes").select("key", _get("value", "$", _NODE).alias("n"))
    return nodes.select(
        F.col("key").alias("unique_id"),
        "n.resource_type",
        "n.name",
        "n.alias",
        "n.schema",
        "n.database",
        "n.columns",
        "n.attached_node",
        "n.column_name",
        F.col("n.test_metadata.kwargs.model").alias("test_model"),
    )


def manifest_sources(artifacts: DataFrame) -> DataFrame:
    return entries(artifacts, "$.sources").select(
        F.col("key").alias("unique_id"), *[_get("value", f"$.{c}").alias(c) for c in _SOURCE_TEXTS]
    )


def result_rows(artifacts: DataFrame) -> DataFrame:
    """One row per result of the runs, with its run's header fields."""
    header = [
        F.coalesce(_get("artifact", "$.metadata.invocation_id"), F.lit("unknown")).alias("invocation_id"),
        *[_get("artifact", f"$.metadata.{c}").alias(c) for c in _HEADER_TEXTS],
    ]
    return entries(artifacts, "$.results", *header).select(
        "invocation_id",
        *_HEADER_TEXTS,
        _get("value", "$.unique_id").alias("unique_id"),
        _get("value", "$.status").alias("status"),
        _get("value", "$.execution_time", "double").alias("execution_time"),
        _get("value", "$.failures", "bigint").alias("failures"),
        _get("value", "$.message").alias("message"),
    )
