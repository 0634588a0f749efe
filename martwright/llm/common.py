"""Shared plumbing: code for the executors, stored intermediate tables, Arrow loops."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.session import scratch_path

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    archive = f"{tempfile.mkdtemp(prefix='martwright-')}/{_PACKAGE.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage; later steps and retried tasks see the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tidy(function: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workers live on after a task; what Arrow no longer uses goes back to the machine."""
    yield from function(batches)
    pa.default_memory_pool().release_unused()


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with the package's code at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(partial(_tidy, function), schema)


def as_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; NULL becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """One output batch; arrays are cast to the schema's types."""
    return pa.RecordBatch.from_arrays(
        [
            columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
            for f in schema
        ],
        schema=schema,
    )
