"""Data-quality checks, suite runs and drift gates."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.columns import any_of, as_stamp, packed_text
from martwright.schemas import EXECUTION_LOGS
from martwright.session import small_partitions


@dataclass(frozen=True)
class Check:
    """One rule on one table. Row rules make the predicate of a failing row."""

    table: str
    rule: str
    column: str
    severity: str = "error"
    failing: Callable[[], Column] | None = None
    parent: str | None = None
    parent_column: str | None = None
    label: str = ""
    # What the rule was declared with: accepted values, the rest of an expression, other columns.
    terms: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        name = f"{self.rule}_{self.table}_{self.column}"
        return f"{name}_{self.label}" if self.label else name


def not_null(table: str, column: str, severity: str = "error") -> Check:
    return Check(table, "not_null", column, severity, lambda: F.col(column).isNull())


def unique(table: str, column: str, severity: str = "error") -> Check:
    return Check(table, "unique", column, severity)


def accepted(table: str, column: str, values: list[str], severity: str = "error") -> Check:
    """Values outside the list fail; NULL passes."""
    return Check(table, "accepted_values", column, severity, lambda: ~F.col(column).isin(values), terms=tuple(values))


def relationships(
    table: str, column: str, parent: str, parent_column: str, severity: str = "error"
) -> Check:
    return Check(
        table, "relationships", column, severity, parent=parent, parent_column=parent_column
    )


def expression(
    table: str, column: str, rest: str, severity: str = "error", label: str = ""
) -> Check:
    """``column rest`` must not be false; NULL passes. ``label`` tells two on a column apart."""
    return Check(table, "expression_is_true", column, severity, lambda: ~F.expr(f"{column} {rest}"), label=label, terms=(rest,))


def clean_trimmed(table: str, column: str, severity: str = "error") -> Check:
    def bad() -> Column:
        value = F.col(column)
        return (value != F.trim(value)) | value.contains("  ")

    return Check(table, "is_clean_trimmed", column, severity, bad)


def _not_before(start: str, end: str) -> Column:
    return (
        (F.col(start) >= F.col(end)) & F.col(start).isNotNull() & F.col(end).isNotNull()
    )


def date_before(table: str, column: str, end: str, severity: str = "error") -> Check:
    return Check(table, "is_date_before", column, severity, lambda: _not_before(column, end), terms=(end,))


def date_before_any(table: str, column: str, others: list[str], severity: str = "error") -> Check:
    def bad() -> Column:
        return any_of([_not_before(column, other) for other in others])

    return Check(table, "is_date_before_columns", column, severity, bad, terms=tuple(others))


def _entry(number: int, value: Column, own: int) -> Column:
    return F.struct(
        F.lit(number).alias("check"),
        value.cast("string").alias("value"),
        F.lit(own).cast("long").alias("own"),
        F.lit(1 - own).cast("long").alias("known"),
    )


def _entries(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """What the rows of a table have to say on all checks, from one scan.

    A row rule gets an entry for each failing row; a key rule one for each value, and a
    relationship one for each value of its parent as well.
    """
    entries = []
    for number, check in enumerate(checks):
        if check.table == table:
            value = F.col(check.column)
            if check.failing is not None:
                entries.append(F.when(check.failing(), _entry(number, F.lit(None), 1)))
            else:
                entries.append(F.when(value.isNotNull(), _entry(number, value, 1)))
        if check.parent == table:
            value = F.col(check.parent_column)
            entries.append(F.when(value.isNotNull(), _entry(number, value, 0)))
    said = df.select(F.inline(F.array_compact(F.array(*entries))))
    return said.withColumn("value", packed_text("value"))


def suite_failures(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """Failing counts of every check as one lazy frame.

    Each table is scanned once, and all key rules share one grouping by check and value, in
    which rows of a common value are combined before the shuffle: repeated values are those with
    several rows, orphans the rows of values that no parent holds. Keys are compared as text,
    packed for the shuffle.
    """
    if not checks:
        raise ValueError("no checks to run")
    used = dict.fromkeys(t for c in checks for t in (c.table, c.parent) if t)
    said = reduce(DataFrame.unionByName, [_entries(tables[t], t, checks) for t in used])
    values = said.groupBy("check", "value").agg(
        F.sum("own").alias("own"), F.sum("known").alias("known")
    )
    by_row = [i for i, c in enumerate(checks) if c.failing is not None]
    by_value = [i for i, c in enumerate(checks) if c.failing is None and not c.parent]
    failing = (
        F.when(F.col("check").isin(by_row), F.col("own"))
        .when(F.col("check").isin(by_value), (F.col("own") > 1).cast("long"))
        .when(F.col("known") == 0, F.col("own"))
        .otherwise(0)
    )
    counted = values.groupBy("check").agg(F.sum(failing).alias("_failures"))
    labels = [F.struct(F.lit(i).alias("check"), *_labels(c)) for i, c in enumerate(checks)]
    declared = said.sparkSession.range(1).select(F.inline(F.array(*labels)))
    # Checks without an entry have nothing that fails.
    return declared.join(counted, "check", "left").select(
        "node_name",
        "target_table",
        "column_name",
        "severity",
        F.coalesce("_failures", F.lit(0).cast("long")).alias("failures"),
    )


def _labels(check: Check) -> list[Column]:
    return [
        F.lit(check.name).alias("node_name"),
        F.lit(check.table).alias("target_table"),
        F.lit(check.column).alias("column_name"),
        F.lit(check.severity).alias("severity"),
    ]


def graded_status(failures="failures", severity="severity") -> Column:
    count, level = F.col(failures), F.col(severity)
    return F.when(count == 0, "pass").when(level == "warn", "warn").otherwise("fail")


def grade(results: DataFrame) -> DataFrame:
    """pass / warn / fail from the failing count and the severity."""
    return results.withColumn("status", graded_status())


def run_suite(
    tables: dict[str, DataFrame], checks: list[Check], run_id: str, as_of, size: str = "8m"
) -> DataFrame:
    """Run every check now and return execution-log rows with their seconds.

    Only the counts, one row per check, come to the driver. The seconds of the shared pass are
    split evenly over the checks. The pass runs in partitions of ``size``, as a task holds all values
    of its rows to combine them: larger ones take more memory and send common values less often.
    """
    failures = suite_failures(tables, checks)
    started = time.perf_counter()
    with small_partitions(failures.sparkSession, size):
        counted = failures.collect()
    seconds = round((time.perf_counter() - started) / len(checks), 2)
    measured = failures.sparkSession.createDataFrame(
        [(*row, seconds) for row in counted],
        "node_name string, target_table string, column_name string, severity string,"
        "failures long, execution_time_seconds double",
    )
    return as_execution_logs(grade(measured), run_id, as_of)


def as_execution_logs(graded: DataFrame, run_id: str, as_of) -> DataFrame:
    seconds = (
        F.col("execution_time_seconds")
        if "execution_time_seconds" in graded.columns
        else F.lit(None).cast("double").alias("execution_time_seconds")
    )
    failed = F.col("status") != "pass"
    message = F.concat(
        F.lit("Got "), F.col("failures").cast("string"), F.lit(" results, expected 0")
    )
    return graded.select(
        F.lit(run_id).alias("execution_id"),
        as_stamp(as_of).alias("run_timestamp"),
        F.lit("test").alias("resource_type"),
        "node_name",
        "target_table",
        "column_name",
        "status",
        seconds,
        F.col("failures").alias("rows_affected"),
        F.when(failed, message).alias("error_message"),
    ).select(*EXECUTION_LOGS.names)


# --- drift -------------------------------------------------------------------


def _sides(built: DataFrame, shipped: DataFrame) -> DataFrame:
    return built.withColumn("_built", F.lit(True)).unionByName(
        shipped.withColumn("_built", F.lit(False))
    )


def table_drift(
    built: dict[str, DataFrame],
    shipped: dict[str, DataFrame],
    numeric: dict[str, list[str]],
    tol: float = 0.01,
) -> DataFrame:
    """Differing row counts, then differing numeric sums, and missing tables.

    Sums are only compared where the counts agree.
    """
    spark = next(iter([*built.values(), *shipped.values()])).sparkSession
    schema = "table_name string, measure string, built_value double, shipped_value double"
    found, missing = [], []
    for table, columns in numeric.items():
        if table not in built or table not in shipped:
            for side, frames in (("built", built), ("shipped", shipped)):
                if table not in frames:
                    missing.append((table, f"missing from {side}", None, None))
            continue
        sides = [
            frames[table].agg(
                F.count(F.lit(1)).cast("double").alias("row_count"),
                *[
                    F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(f"sum_{c}")
                    for c in columns
                ],
            )
            for frames in (built, shipped)
        ]
        measures = ["row_count", *[f"sum_{c}" for c in columns]]
        # Two rows in, one row out.
        merged = _sides(*sides).agg(
            *[
                F.max(F.when(F.col("_built") == side, F.col(m))).alias(f"{m}_{side}".lower())
                for m in measures
                for side in (True, False)
            ]
        )
        same_rows = F.col("row_count_true") == F.col("row_count_false")
        pairs = F.array(
            *[
                F.struct(
                    F.lit(table).alias("table_name"),
                    F.lit(m).alias("measure"),
                    F.col(f"{m}_true".lower()).alias("built_value"),
                    F.col(f"{m}_false".lower()).alias("shipped_value"),
                    same_rows.alias("_same_rows"),
                )
                for m in measures
            ]
        )
        rows = merged.select(F.inline(pairs))
        differs = F.abs(F.col("built_value") - F.col("shipped_value")) > tol
        found.append(
            rows.filter(
                ((F.col("measure") == "row_count") & ~F.col("_same_rows"))
                | ((F.col("measure") != "row_count") & F.col("_same_rows") & differs)
            ).drop("_same_rows")
        )
    if missing or not found:
        found.append(spark.createDataFrame(missing, schema))
    return reduce(DataFrame.unionByName, found)


# Checksums are compared on this many buckets, then on as many inside each unequal one.
DRIFT_BUCKETS = 4096


def _row_hashes(df: DataFrame, cols: list[str], side: bool) -> DataFrame:
    """Rows with a 128-bit hash; a NULL is told from its neighbours by its place."""
    marks = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    return df.select(
        *cols,
        F.xxhash64(marks, *cols).alias("_h1"),
        F.xxhash64(F.lit("second"), marks, *cols).alias("_h2"),
        F.lit(side).alias("_built"),
    )


def unequal_buckets(rows: DataFrame, buckets: list[Column]) -> DataFrame:
    """Buckets whose distinct rows differ between the sides, by order-free checksums.

    A checksum is the exclusive or of the hashes of the distinct rows, with their number. Only
    one small row per bucket and side leaves a task once repeated rows are settled.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    keyed = rows.select(*[b.alias(n) for b, n in zip(buckets, names)], "_h1", "_h2", "_built")
    once = keyed.groupBy(*names, "_h1", "_h2").agg(
        F.bool_or("_built").alias("_in_built"), F.bool_or(~F.col("_built")).alias("_in_shipped")
    )
    zero = F.lit(0).cast("long")

    def checksum(held: str, column: str) -> Column:
        return F.bit_xor(F.when(F.col(held), F.col(column)).otherwise(zero))

    sums = once.groupBy(*names).agg(
        *[checksum(held, h).alias(f"{held}{h}") for held in ("_in_built", "_in_shipped") for h in ("_h1", "_h2")],
        F.count_if("_in_built").alias("_n_built"),
        F.count_if("_in_shipped").alias("_n_shipped"),
    )
    same = (
        (F.col("_in_built_h1") == F.col("_in_shipped_h1"))
        & (F.col("_in_built_h2") == F.col("_in_shipped_h2"))
        & (F.col("_n_built") == F.col("_n_shipped"))
    )
    return sums.filter(~same).select(*names)


def row_drift(built: DataFrame, shipped: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows only one side holds.

    Rows are compared by a checksum tree: hashes fall into buckets, and only the buckets whose
    order-free checksums differ are compared row by row. Where both sides agree, a task sends
    hashes and no rows. The buckets that differ are few numbers, broadcast.
    """
    rows = _row_hashes(built, cols, True).unionByName(_row_hashes(shipped, cols, False))
    bucket = F.pmod("_h1", F.lit(DRIFT_BUCKETS))
    # At most one row per bucket.
    wanted = F.broadcast(unequal_buckets(rows, [bucket]))
    left = rows.join(wanted, bucket == F.col("_b0"), "left_semi")
    held = left.groupBy(*cols).agg(
        F.bool_or("_built").alias("_in_built"), F.bool_or(~F.col("_built")).alias("_in_shipped")
    )
    return (
        held.filter(F.col("_in_built") != F.col("_in_shipped"))
        .withColumn(
            "difference",
            F.when(F.col("_in_built"), "missing from shipped").otherwise("no longer built"),
        )
        .drop("_in_built", "_in_shipped")
    )


def _picked(side: bool, value: Column) -> Column:
    return F.max(F.when(F.col("_built") == side, value))


def field_drift(built: DataFrame, shipped: DataFrame, fields: list[str]) -> DataFrame:
    """Differing fields of two summary rows, NULL equal to NULL."""
    long = [
        frame.select(*[F.col(f).cast("string") for f in fields]).unpivot(
            [], fields, "field", "value"
        )
        for frame in (built, shipped)
    ]
    return (
        _sides(*long)
        .groupBy("field")
        .agg(
            _picked(True, F.col("value")).alias("built_value"),
            _picked(False, F.col("value")).alias("shipped_value"),
        )
        .filter(~F.col("built_value").eqNullSafe(F.col("shipped_value")))
    )


def latest_drift(
    built: DataFrame, shipped: DataFrame, key: str, ts: str, fields: list[str]
) -> DataFrame:
    """Newest row per key of both sides: keys only one side has, and differing fields."""

    def newest(frame: DataFrame) -> DataFrame:
        values = [F.col(f).cast("string").alias(f) for f in fields]
        return (
            frame.filter(F.col(key).isNotNull() & (F.col(key) != ""))
            .groupBy(key)
            .agg(F.max_by(F.struct(*values), F.struct(F.col(ts), *values)).alias("_row"))
        )

    pairs = (
        _sides(newest(built), newest(shipped))
        .groupBy(key)
        .agg(_picked(True, F.col("_row")).alias("_b"), _picked(False, F.col("_row")).alias("_s"))
    )
    one_sided = F.col("_b").isNull() | F.col("_s").isNull()
    entries = [
        F.struct(
            F.lit(f).alias("field"),
            F.col("_b")[f].alias("built_value"),
            F.col("_s")[f].alias("shipped_value"),
            (~one_sided & ~F.col("_b")[f].eqNullSafe(F.col("_s")[f])).alias("_keep"),
        )
        for f in fields
    ]
    whole = F.struct(
        F.lit("*").alias("field"),
        F.when(F.col("_b").isNotNull(), "present").alias("built_value"),
        F.when(F.col("_s").isNotNull(), "present").alias("shipped_value"),
        one_sided.alias("_keep"),
    )
    return (
        pairs.select(key, F.inline(F.array(whole, *entries))).filter("_keep").drop("_keep")
    )
