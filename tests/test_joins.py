"""Skewed joins, pushdown and distributed ranks."""

import random
import statistics
import struct
from contextlib import contextmanager
from pathlib import Path

import pytest
from conftest import row_set, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from martwright.operators import kpis
from martwright.operators.joins import orphans
from martwright.operators.ranking import (
    ascending,
    descending,
    exact_median,
    global_rank,
    ordered_bits,
    restored,
    top_k,
)
from martwright.registry import Tables
from martwright.session import shared_dir
from martwright.sources.star import merged_sales


def skewed(frame, n=3000):
    """A third of the rows on one key, some NULL keys, many copies."""
    pick = random.Random(7)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{pick.randrange(80)}"
        data.append((key, i % 50, f"row{i % 400}"))
    return frame(data, "key string, v long, note string")


def largest_task_share(joined):
    """Rows of the largest task over all; every column of the join is needed."""
    task = joined.select(F.spark_partition_id().alias("p"), F.struct("*").alias("row"))
    counts = [r.n for r in task.groupBy("p").agg(F.count("*").alias("n"), F.max("row")).collect()]
    return max(counts) / sum(counts)


@contextmanager
def settings(spark, **conf):
    conf = {"spark.sql." + k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_and_null_keys_are_split_by_their_size(spark, tmp_path):
    wide = F.concat(*(F.md5(F.concat(F.lit(f"{i} "), F.col("id"))) for i in range(8)))
    share = F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 > 7, F.concat(F.lit("k"), F.col("id") % 997))
    path = str(tmp_path / "left")
    spark.range(60_000, numPartitions=16).select(share.alias("key"), wide.alias("note")).write.parquet(path)
    lookup = spark.range(997).select(F.concat(F.lit("k"), F.col("id")).alias("key"), "id")
    lookup = lookup.union(spark.sql("SELECT 'hot', -1L"))
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        shuffle__partitions="16",
        adaptive__advisoryPartitionSizeInBytes="256k",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="256k",
    ):
        joined = spark.read.parquet(path).join(lookup, "key", "left").select("key", "id", "note")
        assert largest_task_share(joined) < 0.2
        assert joined.filter("key = 'hot' and id = -1").count() == 36_000
        assert joined.filter("key is null and id is null").count() == 12_000


def test_a_dashboard_filter_reaches_the_fact_scan(spark, tmp_path):
    tables = Tables(spark, "/root/testdata/sf0.001")
    names = ("fct_sales", "dim_products", "dim_customers")
    for name in names:
        getattr(tables, name).write.parquet(str(tmp_path / name))
    stored = Tables(spark, "/root/testdata/sf0.001", {n: str(tmp_path / n) for n in names})
    with settings(spark, autoBroadcastJoinThreshold="-1", maxMetadataStringLength="4000"):
        sales = merged_sales(stored.fct_sales, stored.dim_products, stored.dim_customers)
        month = kpis.slice_sales(sales, "1997-04-01", "1997-04-30")
        frame = kpis.revenue_by_country(month)
        plan = frame._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "order_date" in line)
    assert "1997-04-01" in scan and "1997-04-30" in scan
    read = scan.split("ReadSchema: struct<")[1]
    assert {c.split(":")[0] for c in read.rstrip(">").split(",") if ":" in c} <= {
        "product_key", "customer_key", "order_date", "gross_sales_amount"
    }


def test_orphans_counts_rows_per_missing_key(frame):
    child = frame([("a",), ("b",), ("b",), (None,)], "k string")
    parent = frame([("a",), ("a",)], "p string")
    assert rows(orphans(child, "k", parent, "p")) == [("b", 2)]


def jobs_of(spark):
    return spark.sparkContext.statusTracker().getJobIdsForGroup(None)


@pytest.mark.parametrize("ranges, sample", [(128, 8192), (16, 40), (2, 1)])
def test_global_rank_equals_window_rank(spark, frame, tmp_path, ranges, sample):
    df = skewed(frame).withColumn("id", F.xxhash64("key", "v")).distinct()
    df = df.withColumn("v", F.when(F.col("v") % 5 != 0, F.col("v")))
    jobs, scratch = len(jobs_of(spark)), sorted(Path(shared_dir(spark).removeprefix("file:")).iterdir())
    ranked = global_rank(df, [*descending("v"), *ascending("id")], "n", ranges, sample)
    assert len(jobs_of(spark)) == jobs
    window = Window.orderBy(F.desc_nulls_last("v"), F.col("id"))
    expected = df.select("id", F.row_number().over(window).cast("long").alias("n"))
    assert row_set(ranked, "id", "n") == row_set(expected)
    assert sorted(Path(shared_dir(spark).removeprefix("file:")).iterdir()) == scratch


def test_global_rank_of_nothing(frame):
    empty = frame([], "a int")
    assert rows(global_rank(empty, ascending("a"), "n")) == []


def test_ordered_bits_order_like_the_values(frame):
    pick = random.Random(6)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.0**-1022, 2.0**1023, 1.7976931348623157e308, float("inf")]
    values += [2.0**i * (1 + s * 2.0**-52) for i in range(-1000, 1000, 37) for s in (0, 1, 2)]
    values += [2.0**i * (2 - 2.0**-52) for i in range(-1000, 1000, 41)]
    values += [struct.unpack("<d", struct.pack("<Q", pick.getrandbits(63) % (0x7FF << 52)))[0] for _ in range(300)]
    values += [-v for v in values]
    df = frame([(v,) for v in values], "v double").withColumn("bits", ordered_bits(F.col("v")))
    found = df.select("v", "bits", restored(F.col("bits")).alias("back")).collect()
    assert all(r.v == r.back for r in found)
    unsigned = sorted((r.bits % (1 << 64), r.v) for r in found)
    assert [v for _, v in unsigned] == sorted(values)
    assert len({b for b, _ in unsigned}) == len(set(values))


def test_exact_median_odd_even_and_nulls(spark, frame):
    many = [float(i % 7) for i in range(50)]
    spread = [(-1.0) ** i * 1.1**i for i in range(400)]
    for values, expected in (
        ([3, 1, 2], 2.0),
        ([4, 1, 2, 3], 2.5),
        ([5, None], 5.0),
        ([], None),
        ([None, None], None),
        ([1, 1, 1, 9], 1.0),
        ([-2, -1, 1, 1], 0.0),
        ([0.1, 0.1 + 2**-55, 0.1 + 2**-54], 0.1 + 2**-55),
        (many, statistics.median(many)),
        (spread, statistics.median(spread)),
    ):
        df = frame([(None if v is None else float(v),) for v in values], "v double")
        jobs = len(jobs_of(spark))
        median = exact_median(df, "v")
        assert len(jobs_of(spark)) == jobs
        assert rows(median) == [(expected,)]


def test_top_k_numbers_rows(frame):
    df = frame([(i,) for i in range(20)], "v int")
    assert rows(top_k(df, [F.desc("v")], 3, "n")) == [(19, 1), (18, 2), (17, 3)]
