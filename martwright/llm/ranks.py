"""Ranks and running sums inside groups of any size, from one range sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import shuffle_width, stored


def same(left: DataFrame, right: DataFrame, names: list[str], other: list[str]) -> Column:
    """Equality of columns pair by pair; NULL equals NULL."""
    condition = F.lit(True)
    for a, b in zip(names, other):
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def ranked(
    df: DataFrame, group: list[str], order: list[Column], sums: tuple[str, ...] = ()
) -> DataFrame:
    """The rows with ``_rank`` (from 0) in their group and ``_sum_<column>`` up to and with the row.

    Rows are range-sorted by group and order, so a group of any size lies in consecutive
    partitions and none has to fit in a task. Each partition numbers its own part of a group;
    what the group had before is added afterwards. Only the group that continues from the
    partition before has such an offset: one row for each partition at most, so these rows are
    broadcast. The sorted rows are stored once: ranks of tied rows never change.
    """
    keys = [F.col(c).asc_nulls_first() for c in group]
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order)
    rows = stored(
        dealt.sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_slot", F.monotonically_increasing_id()),
        "ranked",
    )
    upto = (
        Window.partitionBy("_part", *group)
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.select(
        "*",
        (F.count(F.lit(1)).over(upto) - 1).alias("_rank"),
        *(F.sum(c).over(upto).alias(f"_sum_{c}") for c in sums),
    )
    names = ["_rank", *(f"_sum_{c}" for c in sums)]
    totals = rows.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_rank"), *(F.sum(c).alias(f"_sum_{c}") for c in sums)
    )
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_at"),
        *(F.col(c).alias(f"_of_{i}") for i, c in enumerate(group)),
        *(F.sum(c).over(before).alias(f"_add{c}") for c in names),
    ).filter("_add_rank is not null")
    here = same(local, offsets, group, [f"_of_{i}" for i in range(len(group))])
    joined = local.join(F.broadcast(offsets), (local["_part"] == offsets["_at"]) & here, "left")
    return joined.select(
        *(local[c] for c in df.columns),
        *((local[c] + F.coalesce(offsets[f"_add{c}"], F.lit(0))).alias(c) for c in names),
    )
