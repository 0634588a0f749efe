"""Distributed global ordering: counting ranks, selection and top-k, all of them lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows are ranked inside this many ranges, cut at quantiles of a sample.
RANGES = 128
SAMPLE_ROWS = 8192
# Bits of a value settled by one histogram.
RADIX_BITS = 16


def ascending(column: str) -> list[Column]:
    """Sort key of a column, smallest first and NULL last."""
    return [F.col(column).isNull(), F.col(column)]


def descending(column: str) -> list[Column]:
    """Sort key of a number, largest first and NULL last."""
    return [F.col(column).isNull(), -F.col(column)]


def range_bounds(df: DataFrame, key: Column, ranges: int, sample_rows: int) -> Column:
    """Ascending keys that cut the rows into ranges of about equal size, as a scalar subquery.

    The sample is the rows with the smallest hashes, so every evaluation cuts alike.
    """
    sample = df.select(key.alias("_key")).withColumn("_hash", F.xxhash64("_key"))
    sample = sample.orderBy("_hash", "_key").limit(sample_rows)
    found = sample.agg(F.sort_array(F.collect_list("_key")).alias("_keys"))
    numbers = F.sequence(F.lit(1), F.lit(ranges - 1))
    at = F.transform(numbers, lambda i: F.floor(F.size("_keys") * i / F.lit(ranges)).cast("int"))
    return found.select(F.transform(at, lambda i: F.get("_keys", i)).alias("_bounds")).scalar()


def global_rank(
    df: DataFrame,
    order: list[Column],
    name: str,
    ranges: int = RANGES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``row_number`` over the whole frame without a one-task window.

    ``order`` are sort keys as of ``ascending`` and ``descending``; together they must tell all
    rows apart. The rows fall into ranges between bounds taken from a sample; rows are counted per
    range and ranked inside each, and a range starts after the counts of those before. Nothing runs or is written before an action. The rows must come out the same
    whenever they are computed, so sums should be of decimals.
    """
    if ranges < 2:
        raise ValueError("ranges must be two or more")
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    ranged = df.withColumn("_bounds", range_bounds(df, key, ranges, sample_rows))
    ranged = ranged.withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= key)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.drop("_bounds")
        .withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_row") + F.col("_offset")).cast("long"))
        .drop("_range", "_row", "_offset")
    )


def top_k(df: DataFrame, order: list[Column], k: int, name: str | None = None) -> DataFrame:
    """First ``k`` rows of a total order, optionally numbered; never a full sort."""
    head = df.orderBy(*order).limit(k)
    if name is None:
        return head
    return head.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


_TOP = -(1 << 63)
_REST = (1 << 63) - 1


def _long(number: int) -> Column:
    return F.lit(number).cast("long")


def ordered_bits(value: Column) -> Column:
    """The 64 bits of a double, changed so that as unsigned numbers they order like the values.

    Exponent and fraction come from exact arithmetic with powers of two. The sign bit is set for
    positive values, all bits are flipped for negative ones. NaN is the largest, zeros are equal.
    """
    size = F.abs(value)
    near = F.floor(F.log2(size)).cast("int")
    # The logarithm may be one off next to a power of two.
    power = near + F.when(F.pow(F.lit(2.0), near + 1) <= size, 1).when(F.pow(F.lit(2.0), near) > size, -1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("long")
    magnitude = (
        F.when(F.isnan(value), _long(0x7FF8 << 48))
        .when(size == float("inf"), _long(0x7FF << 52))
        .when(size < 2.0**-1022, (size * 2.0**1022 * float(1 << 52)).cast("long"))
        .otherwise(F.shiftleft((power + 1023).cast("long"), 52) + fraction)
    )
    negative = (value < 0) & ~F.isnan(value)
    return F.when(negative, F.bitwise_not(magnitude).bitwiseAND(_long(_REST))).otherwise(
        magnitude.bitwiseOR(_long(_TOP))
    )


def restored(bits: Column) -> Column:
    """The double of ``ordered_bits``."""
    magnitude = F.when(bits < 0, bits.bitwiseAND(_long(_REST))).otherwise(
        F.bitwise_not(bits).bitwiseAND(_long(_REST))
    )
    power = F.shiftright(magnitude, 52).cast("int")
    fraction = magnitude.bitwiseAND(_long((1 << 52) - 1)).cast("double") / float(1 << 52)
    size = (
        F.when((power == 2047) & (fraction > 0), F.lit(float("nan")))
        .when(power == 2047, F.lit(float("inf")))
        .when(power == 0, fraction * 2.0**-1022)
        .otherwise((fraction + 1) * F.pow(F.lit(2.0), power - 1023))
    )
    return F.when(bits < 0, size).otherwise(-size)


def median_rows(df: DataFrame, value: str) -> DataFrame:
    """The one or two middle values of a column, NULL left out, as rows ``_target, _value``.

    Radix selection: a histogram of the highest sixteen bits tells in which of 65,536 buckets
    each middle rank falls; the next one looks at the next sixteen bits inside these buckets.
    After four histograms all bits are settled. No rows are sorted or stored, and nothing runs
    before an action; what the rounds share is computed once where exchanges are reused.
    """
    bits = df.filter(F.col(value).isNotNull()).select(ordered_bits(F.col(value).cast("double")).alias("_bits"))
    mask, state = F.lit((1 << RADIX_BITS) - 1), None
    for done in range(0, 64, RADIX_BITS):
        digit = F.shiftrightunsigned("_bits", 64 - RADIX_BITS - done).bitwiseAND(mask).alias("_digit")
        if state is None:
            counts = bits.groupBy(digit).agg(F.count(F.lit(1)).alias("_rows"))
            # At most 65,536 rows, for each of two ranks.
            size = F.sum("_rows").over(Window.partitionBy(F.lit(0)))
            ranks = [F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1]
            targets = [F.struct(F.lit(i).alias("_target"), r.alias("_left")) for i, r in enumerate(ranks)]
            counts = counts.withColumn("_size", size).select("_digit", "_rows", F.inline(F.array(*targets)))
            counts = counts.withColumn("_prefix", F.lit(0).cast("long"))
        else:
            here = F.shiftrightunsigned("_bits", 64 - done) == F.col("_prefix")
            # Two rows.
            rest = bits.join(F.broadcast(state), here)
            counts = rest.groupBy("_target", "_left", "_prefix", digit).agg(F.count(F.lit(1)).alias("_rows"))
        upto = Window.partitionBy("_target").orderBy("_digit")
        upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_upto", F.sum("_rows").over(upto))
        below = F.col("_upto") - F.col("_rows")
        state = counts.filter((below < F.col("_left")) & (F.col("_left") <= F.col("_upto"))).select(
            "_target",
            F.shiftleft("_prefix", RADIX_BITS).bitwiseOR(F.col("_digit")).alias("_prefix"),
            (F.col("_left") - below).alias("_left"),
        )
    return state.select("_target", restored(F.col("_prefix")).alias("_value"))


def exact_median(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """Median of a column as a one-row frame; NULL if it has no value."""
    return median_rows(df, value).agg(F.avg("_value").alias(name))
