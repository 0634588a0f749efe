import datetime as dt

from conftest import row_set, rows
from pyspark.sql import functions as F

from martwright.operators import quality as q
from martwright.plans.suites import all_checks, bronze_checks, gold_checks, silver_checks
from martwright.schemas import EXECUTION_LOGS
from martwright.session import small_partitions


def failing(df, check, **more):
    return rows(q.suite_failures({check.table: df, **more}, [check]), "failures")[0][0]


def test_row_rules(frame):
    df = frame(
        [(1, "ok", 1, 2), (2, " x", 5, 5), (None, "a  b", None, 3), (4, None, 4, None)],
        "id int, name string, a int, b int",
    )
    assert failing(df, q.not_null("t", "id")) == 1
    assert failing(df, q.clean_trimmed("t", "name")) == 2
    assert failing(df, q.accepted("t", "name", ["ok"])) == 2
    assert failing(df, q.expression("t", "id", "> 1")) == 1
    assert failing(df, q.date_before("t", "a", "b")) == 1
    assert failing(df, q.date_before_any("t", "b", ["a", "id"])) == 2


def test_unique_counts_values_and_relationships_count_rows(frame):
    df = frame([("a",), ("a",), ("a",), ("b",), ("c",), ("c",), (None,), (None,)], "k string")
    assert failing(df, q.unique("t", "k")) == 2
    parent = frame([("a",), ("b",)], "p string")
    assert failing(df, q.relationships("t", "k", "parent", "p"), parent=parent) == 2


def test_expression_without_column_value(frame):
    df = frame([("2999-01-01",), ("bad",), (None,), ("1990-01-01",)], "bdate string")
    rule = "is null or try_cast(bdate as date) <= current_date()"
    assert failing(df, q.expression("t", "bdate", rule)) == 1


def test_row_rules_of_a_table_share_one_pass(frame):
    df = frame([(1, "x")], "id int, name string")
    checks = [q.not_null("t", "id"), q.not_null("t", "name"), q.clean_trimmed("t", "name")]
    plan = q.suite_failures({"t": df}, checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_stored_tables_are_scanned_once(spark, frame, tmp_path):
    """All rules of a table, and of those that refer to it, come from one scan and one grouping."""
    frame([(1, "x"), (2, "y"), (2, None)], "id int, name string").write.parquet(str(tmp_path / "t"))
    frame([(1, 1), (7, 2), (7, 2), (None, 3)], "t_id int, n int").write.parquet(str(tmp_path / "u"))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in "tu"}
    checks = [
        *[q.not_null("t", c) for c in ("id", "name")],
        *[q.unique("t", c) for c in ("id", "name")],
        q.unique("u", "t_id"),
        q.relationships("u", "t_id", "t", "id"),
        q.relationships("t", "id", "u", "n"),
    ]
    failures = q.suite_failures(tables, checks)
    plan = failures._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert dict(rows(failures, "node_name", "failures")) == {
        "not_null_t_id": 0,
        "not_null_t_name": 1,
        "unique_t_id": 1,
        "unique_t_name": 0,
        "unique_u_t_id": 1,
        "relationships_u_t_id": 2,
        "relationships_t_id": 0,
    }


def test_keys_are_packed_before_the_shuffle(frame):
    """Hex digits leave a task as half their bytes, and text that looks alike stays apart."""
    digits = "0123456789abcdef" * 2
    child = frame([(digits,), (digits,), (digits.upper(),), ("x",), (None,)], "k string")
    parent = frame([(digits,), ("y" * 16,)], "p string")
    checks = [q.unique("t", "k"), q.relationships("t", "k", "parent", "p")]
    said = q._entries(child, "t", checks)
    assert {len(v) for (v,) in rows(said, "value") if v is not None} == {16, 33, 1}
    failures = q.suite_failures({"t": child, "parent": parent}, checks)
    assert rows(failures, "failures") == [(1,), (2,)]


def test_a_table_may_be_empty(frame):
    empty = frame([], "id int, name string")
    checks = [q.not_null("t", "id"), q.unique("t", "id"), q.relationships("t", "id", "t", "id")]
    assert rows(q.suite_failures({"t": empty}, checks), "failures") == [(0,)] * 3


def test_suite_grades_by_severity(frame):
    df = frame([(None, "x"), (1, "x")], "id int, name string")
    checks = [
        q.not_null("t", "id"),
        q.not_null("t", "name"),
        q.unique("t", "name", "warn"),
    ]
    logs = q.run_suite({"t": df}, checks, "run-9", "2026-01-01")
    assert logs.columns == EXECUTION_LOGS.names
    assert row_set(logs, "node_name", "status", "rows_affected", "error_message") == [
        ("not_null_t_id", "fail", 1, "Got 1 results, expected 0"),
        ("not_null_t_name", "pass", 0, None),
        ("unique_t_name", "warn", 1, "Got 1 results, expected 0"),
    ]
    assert logs.first().run_timestamp == dt.datetime(2026, 1, 1)


def test_a_suite_runs_in_small_partitions(spark):
    """A task's memory follows its rows: one shuffle partition, or large ones, are not kept."""
    before = {
        "spark.sql.shuffle.partitions": "1",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.files.maxPartitionBytes": "1m",
    }
    found = {k: spark.conf.get(k) for k in before}
    try:
        for key, value in before.items():
            spark.conf.set(key, value)
        keys = spark.range(600_000).select(F.md5(F.col("id").cast("string")).alias("k"))
        df = keys.repartition("k").withColumn("task", F.spark_partition_id())
        checks = [q.unique("t", "k"), q.expression("t", "task", "= 0")]
        logs = q.run_suite({"t": df}, checks, "run-1", "2026-01-01")
        failing = dict(rows(logs, "node_name", "rows_affected"))
        assert failing["unique_t_k"] == 0
        # At least two tasks of the 20 MB and more.
        assert 0 < failing["expression_is_true_t_task"] < 600_000
        # The session is as it was, and its smaller sizes had been kept.
        assert {k: spark.conf.get(k) for k in before} == before
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None
    finally:
        for key, value in found.items():
            spark.conf.set(key, value)


def test_small_partitions_keep_what_is_smaller_and_end_with_an_error(spark):
    size, first = (f"spark.sql.adaptive.{k}" for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.initialPartitionNum"))
    found = spark.conf.get(size, None)
    try:
        spark.conf.set(size, "512k")
        spark.conf.set(first, "1000")
        try:
            with small_partitions(spark):
                assert (spark.conf.get(size), spark.conf.get(first)) == ("512k", "1000")
                assert spark.conf.get("spark.sql.files.maxPartitionBytes") == f"{32 << 20}b"
                raise ValueError("stopped")
        except ValueError:
            pass
        assert spark.conf.get("spark.sql.files.maxPartitionBytes", None) != f"{32 << 20}b"
    finally:
        spark.conf.unset(first)
        if found is None:
            spark.conf.unset(size)
        else:
            spark.conf.set(size, found)


def test_declared_suites(spark):
    assert [len(s()) for s in (bronze_checks, silver_checks, gold_checks)] == [46, 57, 19]
    names = [c.name for c in all_checks()]
    assert len(set(names)) == len(names)


def test_table_drift_detects_tampering(frame):
    fact = frame([(1, 10.0), (2, 20.0)], "k int, amount double")
    changed = frame([(1, 10.0), (2, 20.5)], "k int, amount double")
    fewer = fact.limit(1)
    numeric = {"fact": ["amount"]}
    assert rows(q.table_drift({"fact": fact}, {"fact": fact}, numeric)) == []
    assert rows(q.table_drift({"fact": fact}, {"fact": changed}, numeric)) == [
        ("fact", "sum_amount", 30.0, 30.5)
    ]
    assert rows(q.table_drift({"fact": fact}, {"fact": fewer}, numeric)) == [
        ("fact", "row_count", 2.0, 1.0)
    ]
    assert rows(q.table_drift({"fact": fact}, {}, numeric), "measure") == [("missing from shipped",)]
    close = frame([(1, 10.0), (2, 20.005)], "k int, amount double")
    assert rows(q.table_drift({"fact": fact}, {"fact": close}, numeric)) == []


def test_row_and_field_drift_treat_null_as_a_value(frame):
    built = frame([("a", 1), ("b", None)], "k string, v int")
    shipped = frame([("a", 1), ("a", 1), ("c", 2)], "k string, v int")
    assert row_set(q.row_drift(built, shipped, ["k", "v"])) == [
        ("b", None, "missing from shipped"),
        ("c", 2, "no longer built"),
    ]
    one = frame([(1, "x", None)], "a int, b string, c int")
    two = frame([(1, "y", None)], "a int, b string, c int")
    assert rows(q.field_drift(one, two, ["a", "b", "c"])) == [("b", "x", "y")]


def test_equal_sides_are_told_by_checksums(spark, frame):
    """Only buckets that differ are compared row by row, whatever the order and repeats."""
    data = [(i, None if i % 7 == 0 else f"v{i % 50}") for i in range(3000)]
    built = frame(data, "k int, v string")
    shipped = frame(data[::-1] + data[:40], "k int, v string").repartition(5)
    both = q._row_hashes(built, ["k", "v"], True).unionByName(q._row_hashes(shipped, ["k", "v"], False))
    bucket = F.pmod("_h1", F.lit(q.DRIFT_BUCKETS))
    assert q.unequal_buckets(both, [bucket]).count() == 0
    assert rows(q.row_drift(built, shipped, ["k", "v"])) == []
    changed = [*data[:100], (100, "other"), *data[101:]]
    other = frame(changed, "k int, v string")
    both = q._row_hashes(built, ["k", "v"], True).unionByName(q._row_hashes(other, ["k", "v"], False))
    unequal = [r[0] for r in q.unequal_buckets(both, [bucket]).collect()]
    # The rows behind them are all that is shuffled as rows.
    compared = both.filter(bucket.isin(unequal)).count()
    assert 1 <= len(unequal) <= 2 and compared < 20
    assert row_set(q.row_drift(built, other, ["k", "v"])) == [
        (100, "other", "no longer built"),
        (100, "v0", "missing from shipped"),
    ]


def test_latest_drift(frame):
    schema = "target string, at string, n int"
    built = frame([("a", "1", 5), ("a", "2", 6), ("b", "1", 1), ("c", "1", None)], schema)
    shipped = frame([("a", "9", 7), ("d", "1", 1), ("c", "1", None)], schema)
    assert row_set(q.latest_drift(built, shipped, "target", "at", ["n"])) == [
        ("a", "n", "6", "7"),
        ("b", "*", "present", None),
        ("d", "*", None, "present"),
    ]
