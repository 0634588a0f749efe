"""Referential checks between a child and a parent table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct non-NULL child keys without a parent, with their row counts.

    Both sides are reduced to one row per key before the anti join, so a hot
    child key costs one row in the shuffle.
    """
    counts = child.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("orphan_rows")
    )
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return counts.join(known, key, "left_anti")
