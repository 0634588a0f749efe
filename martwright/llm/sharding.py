"""Shard placement by a permutation-filled lookup table."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def fill_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of each slot.

    Each name gives a start and a step from its hashes; as the size is prime, the steps visit
    every slot once, in that shard's order of preference. Shards take turns, each claiming its
    next free slot, until none is left: their shares differ by one slot at most, and a change
    of one shard moves few slots between the others.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given once each")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime no smaller than the number of shards")
    places = [xxhash.xxh64_intdigest(n, 1) % slots for n in names]
    steps = [xxhash.xxh64_intdigest(n, 2) % (slots - 1) + 1 if slots > 2 else 1 for n in names]
    table, left = [-1] * slots, slots
    while True:
        for shard, step in enumerate(steps):
            while table[places[shard]] >= 0:
                places[shard] = (places[shard] + step) % slots
            table[places[shard]] = shard
            left -= 1
            if not left:
                return table


def place(
    docs: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS
) -> DataFrame:
    """``(key, slot, shard)`` of every row, by one lookup in the broadcast table.

    The table has ``slots`` small rows whatever the data, so it is broadcast; nothing is
    shuffled. The slot is the XXH64 of the key modulo ``slots``. Equal keys share a shard, also
    repeated rows; a NULL key has a fixed slot. An empty table gives no rows. Other columns
    are not read.
    """
    names = names or [f"shard-{i:05d}" for i in range(SHARDS)]
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(fill_table(names, slots))), "slot long, shard int")
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).alias("slot")
    return docs.select(key, slot).join(F.broadcast(table), "slot").select(key, "slot", "shard")


def write_shards(
    docs: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS
) -> None:
    """Write the documents as Parquet folders ``_shard=<number>``.

    Rows are rebalanced by shard, which splits one too large for a task over several files. A
    NULL key, repeated rows and an empty table are placed as ``place`` does. All columns are
    written; a column named ``_shard`` would be lost in the folder's name, so it is refused.
    """
    if "_shard" in [c.lower() for c in docs.columns]:
        raise ValueError("the column _shard names the folders: rename it first")
    names = names or [f"shard-{i:05d}" for i in range(SHARDS)]
    slot = "_slot"
    while slot in [c.lower() for c in docs.columns]:
        slot = f"_{slot}"
    table = docs.sparkSession.createDataFrame(
        list(enumerate(fill_table(names, slots))), f"{slot} long, _shard int"
    )
    placed = docs.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(slots)))
    placed = placed.join(F.broadcast(table), slot).drop(slot)
    placed.hint("rebalance", "_shard").write.partitionBy("_shard").parquet(path)
