"""Raw file scans: all-text CSV, landing discovery and JSON artifacts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Landing folders that carry a short table prefix, and skipped ones.
FOLDER_PREFIX = {"source_crm": "crm", "source_erp": "erp"}
SKIP_FOLDERS = {".DS_Store", "__pycache__"}


class ArtifactMissing(FileNotFoundError):
    """The artifact path does not exist."""


class ArtifactMalformed(ValueError):
    """The artifact is not a JSON object."""


def scan_csv_text(spark: SparkSession, path: str, quoted_breaks: bool = True) -> DataFrame:
    """CSV with a header, every column text; empty fields NULL, blanks kept.

    A quoted field may hold line breaks. Files known to hold none are split over several
    tasks with ``quoted_breaks=False``.
    """
    return spark.read.csv(
        path,
        header=True,
        inferSchema=False,
        nullValue="",
        emptyValue="",
        quote='"',
        escape='"',
        multiLine=quoted_breaks,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def load_bronze_table(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to declared names and types by position; a bad value fails the job."""
    if len(text.columns) != len(schema.fields):
        raise ValueError(f"expected {len(schema.fields)} columns, found {len(text.columns)}")
    named = text.toDF(*schema.names)
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names stripped and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def list_dir(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, full path, is directory) of a folder on any Hadoop file system, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop) or not system.getFileStatus(hadoop).isDirectory():
        raise FileNotFoundError(f"source folder not found: {path}")
    entries = [
        (s.getPath().getName(), s.getPath().toString(), s.isDirectory())
        for s in system.listStatus(hadoop)
    ]
    return sorted(entries)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


# A refreshed table is a folder of version folders and a marker that names the current one.
MARKER = "_current"
_VERSION = "v_"


def _system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the version folder that readers use; None for a plain folder."""
    marker, system = _system(spark, f"{path}/{MARKER}")
    if not system.exists(marker):
        return None
    stream = system.open(marker)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def table_path(spark: SparkSession, path: str) -> str:
    """Folder that holds the rows of a table now: its current version, or the path itself."""
    version = current_version(spark, path)
    return f"{path}/{version}" if version else path


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Current rows of a table, whether it is refreshed by versions or a plain folder."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(spark, path))


def new_version(path: str) -> str:
    return f"{path.rstrip('/')}/{_VERSION}{uuid.uuid4().hex}"


def switch_version(spark: SparkSession, path: str, version: str) -> None:
    """Make a complete version the current one, by replacing the marker in one step.

    Until then readers find the version before; the new marker is written beside the old one
    and renamed over it.
    """
    name = version.rsplit("/", 1)[-1]
    beside, system = _system(spark, f"{path}/{MARKER}.{name}")
    stream = system.create(beside, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKER}")
    # The kind of rename that may replace a file belongs to the other file API.
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.makeQualified(marker).toUri(), spark._jsc.hadoopConfiguration()
    )
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(system.makeQualified(beside), system.makeQualified(marker), options)


def drop_other_versions(spark: SparkSession, path: str, keep: set[str | None]) -> None:
    """Remove what no reader needs: other versions, markers never switched to, and old plain rows."""
    if not path_exists(spark, path):
        return
    for name, full, _ in list_dir(spark, path):
        stray = name.startswith(f"{MARKER}.")
        plain = not name.startswith(("_", ".", _VERSION)) and None not in keep
        if stray or plain or (name.startswith(_VERSION) and name not in keep):
            remove_path(spark, full)


def discover_csvs(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(CSV path, target table) pairs below the landing folders of ``root``."""
    found = []
    for folder, folder_path, is_dir in list_dir(spark, root):
        if not is_dir or folder in SKIP_FOLDERS:
            continue
        prefix = FOLDER_PREFIX.get(folder, folder)
        # A CSV may be one file or a directory of part files.
        for name, path, _ in list_dir(spark, folder_path):
            if name.endswith(".csv"):
                found.append((path, f"{prefix}_{name.removesuffix('.csv')}".lower()))
    return found


def parse_artifact(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """JSON text column → typed struct; NULL where it is no JSON object."""
    is_object = F.json_object_keys(column).isNotNull()
    return df.withColumn("artifact", F.when(is_object, F.from_json(column, schema)))


def read_artifact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per file; a missing path and bad JSON are distinct errors."""
    if not path_exists(spark, path):
        raise ArtifactMissing(path)
    text = spark.read.text(path, wholetext=True)
    # The keys of anything but a complete JSON object are NULL.
    judged = text.select("value", F.json_object_keys("value").isNotNull().alias("_object"))
    if judged.isEmpty() or not judged.filter(~F.col("_object")).isEmpty():
        raise ArtifactMalformed(f"{path} must contain a JSON object")
    parsed = text.select(F.from_json("value", schema).alias("_a"))
    return parsed.select("_a.*")


def read_section(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A telemetry section with its declared columns; empty when absent or unreadable."""
    empty = spark.createDataFrame([], schema)
    if not path_exists(spark, path):
        return empty
    try:
        found = read_table(spark, path)
    except AnalysisException:
        return empty
    known = set(found.columns)
    return found.select(
        *[
            (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
