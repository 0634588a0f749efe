"""Bitmaps of hashed identifiers, to leave most rows out of a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most 8 MB are broadcast.
FILTER_BITS = 26


def split_by_bitmap(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be in ``ids``, and rows where it is not; NULL is not.

    The bitmap of hashed values is broadcast. With very many ids more other rows pass the first;
    an exact join has to follow, so results are the same at every size.
    """
    names = [f"_{name}_{i}" for i, name in enumerate(("part", "bits", "byte", "shift"))]
    while set(names) & set(rows.columns):
        names = [f"_{n}" for n in names]
    part_name, bits_name, byte_name, shift_name = names
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << FILTER_BITS))
    part, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    known = ids.filter(F.col(column).isNotNull())
    bits = known.groupBy(part.alias(part_name)).agg(F.bitmap_construct_agg(bit).alias(bits_name))
    marked = rows.withColumn(part_name, part).join(F.broadcast(bits), part_name, "left")
    byte = F.conv(F.hex(F.substring(bits_name, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = marked.select(
        *rows.columns,
        F.when(F.col(column).isNotNull(), F.coalesce(byte, F.lit(0))).otherwise(0).alias(byte_name),
        (bit % 8).cast("int").alias(shift_name),
    )
    hit = F.expr(f"(shiftright({byte_name}, {shift_name}) & 1) = 1")
    return marked.filter(hit).select(*rows.columns), marked.filter(~hit).select(*rows.columns)
