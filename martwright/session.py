"""Session helpers: settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Fixed value: shuffle partitions that ``small_partitions`` starts from at least. More than 200 would
# have Spark sort each task's output.
FIRST_PARTITIONS = 200


def build_session(app: str = "martwright", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Joins are plain; a hot key, also the NULL key, is split by its measured size.
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)(?:i?b)?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_partitions(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Shuffle partitions of ``size`` for an action whose tasks sort and group all rows in memory.

    Such rows take some twenty times their shuffled size, so a task's memory follows the size of its
    partition. A few shuffle partitions would grow with the data: there are many at first, and
    adaptive execution merges them up to ``size``; scans are cut at four times that. What the session
    has smaller stays. The settings are the session's: what else it starts meanwhile is cut as small,
    with the same rows.
    """
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    number = spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")
    sizes = {
        "spark.sql.files.maxPartitionBytes": 4 * _bytes(size),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": _bytes(size),
    }
    changes = {k: f"{most}b" for k, most in sizes.items() if _bytes(spark.conf.get(k)) > most}
    if int(number) < FIRST_PARTITIONS:
        changes[first] = str(FIRST_PARTITIONS)
    before = {k: spark.conf.get(k, None) for k in changes}
    try:
        for key, value in changes.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Directory every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="martwright-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh, unused path below the shared directory."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared directory and read it back.

    What was computed once is what later steps see, also after lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

