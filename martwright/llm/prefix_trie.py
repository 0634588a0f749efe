"""Prefix trie of conversations, with subtree totals by depth-band rollup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, shuffle_width, stored
from martwright.llm.ranks import ranked

# Conversations of one hundred share the opening of the first of them, of at most five turns.
FAMILY = 100
OPENINGS = 6
# A node is exploded to its ancestors within bands of this height.
BAND = 16
# Identifiers joined to one text before they are hashed in order.
SEGMENT = 4096
_LIMBS = ("a0", "a1", "a2", "a3")
_KEY = ["depth", "k1", "k2"]


def opening_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS).cast("int")


def original_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, rank, x, n``: turns in order, with a digest of role and text and its code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn"),
        F.sha2(framed.cast("binary"), 256).alias("x"),
        F.length(text).cast("long").alias("n"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("x").asc()]
    return ranked(stored(turns, "turns"), ["conv_id"], order).select(
        "conv_id", F.col("_rank").alias("rank"), "x", "n"
    )


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv_id, total`` and their turns ``conv_id, depth, total, x, n``."""
    turns = stored(turns, "ranked_turns")
    totals = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")), "totals")
    rows = turns.join(totals, "conv_id").select("conv_id", (F.col("rank") + 1).alias("depth"), "total", "x", "n")
    return totals, rows


def with_family_opening(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``as_they_are``, each conversation opened by the first turns of its family's first.

    Conversation c starts with the first h turns of c - c % 100 (all if it has fewer, none if it
    is absent), h = ``opening_turns``; its own turns after its first h follow.
    """
    turns = stored(turns, "ranked_turns")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = stored(own.select("conv_id", "size", family.alias("first_id"), opening_turns(F.col("conv_id")).alias("h")), "own")
    first = own.filter("conv_id = first_id").select(F.col("conv_id").alias("_id"), F.col("size").alias("_size"))
    convs = own.join(first, own["first_id"] == first["_id"], "left").select(
        "conv_id", "first_id", "h", "size", F.least("h", F.coalesce("_size", F.lit(0))).alias("taken")
    )
    total = F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    convs = stored(convs.withColumn("total", total), "convs")
    opening = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("rank") < OPENINGS - 1))
    opening = opening.select(F.col("conv_id").alias("first_id"), "rank", "x", "n")
    taken = convs.join(opening, "first_id").filter("rank < h")
    # A conversation with very many turns is on the left of a plain join, which is split.
    left = turns.join(convs, "conv_id").filter("rank >= h")
    rows = taken.select("conv_id", (F.col("rank") + 1).alias("depth"), "total", "x", "n").unionByName(
        left.select("conv_id", (F.col("taken") + F.col("rank") - F.col("h") + 1).alias("depth"), "total", "x", "n")
    )
    return convs.select("conv_id", "total"), rows


def _paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, total, n, k1, k2, p1, p2``: the node of every turn, and its parent.

    A node's key is the sum, modulo 2^128, of SHA-256 digests of depth and turn along the way.
    Sums come in any order, so a conversation of any length is spread over tasks.
    """
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "x").cast("binary"), 256)
    rows = turns.withColumn("_y", mixed).select(
        "conv_id", "depth", "total", "n",
        *(F.conv(F.substring("_y", 8 * i + 1, 8), 16, 10).cast("long").alias(a) for i, a in enumerate(_LIMBS)),
    )
    rows = ranked(stored(rows, "limbs"), ["conv_id"], [F.col("depth").asc()], _LIMBS)
    low = F.lit((1 << 32) - 1)

    def packed(a: Column, b: Column) -> Column:
        return F.shiftleft(a.bitwiseAND(low), 32).bitwiseOR(b.bitwiseAND(low))

    upto = [F.col(f"_sum_{a}") for a in _LIMBS]
    before = [F.col(f"_sum_{a}") - F.col(a) for a in _LIMBS]
    return stored(
        rows.select(
            "conv_id", F.col("depth").cast("long"), "total", "n",
            packed(*upto[:2]).alias("k1"), packed(*upto[2:]).alias("k2"),
            packed(*before[:2]).alias("p1"), packed(*before[2:]).alias("p2"),
        ),
        "paths",
    )


def band_rollup(items: DataFrame, path: DataFrame, sums: list[str], high: int, band: int = BAND) -> DataFrame:
    """Subtree totals ``depth, k1, k2, conv_id, <sums>`` of every node.

    ``items(conv_id, depth, k1, k2, <sums>)`` are nodes with any conversation through them;
    ``path(conv_id, depth, k1, k2)`` the nodes of each conversation; no depth is above ``high``.
    Each node adds to its ancestors inside its band of ``band`` depths. The tops of the bands
    form a trie of a ``band``-th of the height, which is rolled up in the same way. Their complete
    totals then go to the ancestors in the band above. A node becomes at most ``band`` rows at
    a time, and there are as many rounds as ``high`` has digits to the base ``band``.
    """
    path = path.select(
        F.col("conv_id").alias("_conv"),
        F.col("depth").alias("_depth"),
        F.col("k1").alias("_k1"),
        F.col("k2").alias("_k2"),
        F.floor(F.col("depth") / band).alias("_band"),
    )

    def to_ancestors(nodes: DataFrame, at: Column) -> DataFrame:
        here = (nodes["conv_id"] == path["_conv"]) & (at == path["_band"]) & (path["_depth"] <= nodes["depth"])
        pairs = nodes.join(path, here)
        return pairs.select(
            F.col("_depth").alias("depth"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "conv_id", *sums
        )

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))

    inside = stored(added(to_ancestors(items, F.floor(F.col("depth") / band))), "inside")
    if high < band:
        return inside
    tops = inside.filter(F.col("depth") % band == 0).withColumn("depth", F.floor(F.col("depth") / band))
    names = ["_conv", "_band", "_k1", "_k2"]
    upper = path.filter(F.col("_depth") % band == 0).select(*(F.col(c).alias(c[1:]) for c in names))
    upper = upper.withColumnsRenamed({"conv": "conv_id", "band": "depth"})
    whole = band_rollup(tops, upper, sums, high // band, band)
    below = whole.filter("depth > 0").withColumn("depth", F.col("depth") * band)
    carried = to_ancestors(below, F.floor(F.col("depth") / band) - 1)
    return stored(added(inside.select(*_KEY, "conv_id", *sums).unionByName(carried)), "totals")


_SEGMENTS = pa.schema(
    [("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]
)


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and identifier; neighbours of one node become one text."""
    out: list[tuple] = []
    held: list = [None, []]

    def flush():
        if held[1]:
            out.append((*held[0], held[1][0], ",".join(map(str, held[1]))))
        held[1] = []

    for rows in batches:
        for *key, conv in zip(*(rows.column(c).to_pylist() for c in (*_KEY, "conv_id"))):
            if key != held[0] or len(held[1]) >= SEGMENT:
                flush()
                held[0] = key
            held[1].append(conv)
        if len(out) >= 1 << 12:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEGMENTS)], schema=_SEGMENTS)
            out.clear()
    flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEGMENTS)], schema=_SEGMENTS)


_HASHES = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments come sorted by node and first identifier; only a node's running hash is held."""
    out: list[tuple] = []
    key, state = None, None
    for rows in batches:
        for *here, ids in zip(*(rows.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if here != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = here, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _HASHES)], schema=_HASHES)
            out = []
    if state is not None:
        out.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _HASHES)], schema=_HASHES)


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's identifiers in ascending order, joined by commas.

    Identifiers are range-sorted, so those of one node may lie in many tasks; each task joins
    its own to texts of ``SEGMENT`` identifiers, and one task per node hashes the texts.
    """
    width = shuffle_width(ends.sparkSession)
    order = ["k1", "k2", "depth", "conv_id"]
    dealt = ends.select(*order).repartitionByRange(width, *order).sortWithinPartitions(*order)
    parts = arrow_map(dealt, _join_ids, "depth long, k1 long, k2 long, first long, ids string")
    parts = parts.repartition(width, *_KEY).sortWithinPartitions(*_KEY, "first")
    return arrow_map(parts.select(*_KEY, "ids"), _hash_ids, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, band: int = BAND) -> DataFrame:
    """All nodes of the trie of ``convs(conv_id, total)`` with ``turns(conv_id, depth, total, x, n)``."""
    convs = stored(convs, "members")
    path = _paths(turns)
    root = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), "total", F.lit(0).cast("long").alias("n"),
        *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "p1", "p2")),
    )
    path = root.unionByName(path)
    ending = F.col("total") == F.col("depth")
    nodes = path.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(ending.cast("long")).alias("n_ends"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("n").alias("n"),
    )
    nodes = stored(
        nodes.select(
            *_KEY, "conv_id", "n_convs", "p1", "p2",
            (F.col("n_convs") == F.col("n_ends")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n")).alias("saved_tokens"),
        ),
        "nodes",
    )
    high = nodes.agg(F.max("depth")).first()[0] or 0
    sums = ["n_leaves", "saved_tokens"]
    totals = band_rollup(nodes.select("conv_id", *_KEY, *sums), path.select("conv_id", *_KEY), sums, high, band)
    ends = ends_digest(path.filter(ending))
    children = nodes.filter("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"),
        F.lit(1).cast("long").alias("n_children"),
    )
    rows = nodes.select(*_KEY, "conv_id", "n_convs", "p1", "p2")
    for more in (totals.select(*_KEY, *sums), ends, children):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.groupBy(*_KEY).agg(
        *(F.max(c).alias(c) for c in ("conv_id", "n_convs", "p1", "p2", *sums)),
        F.sum(F.coalesce("n_children", F.lit(0))).alias("n_children"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    parents = nodes.select(
        (F.col("depth") + 1).alias("_depth"), F.col("k1").alias("_p1"), F.col("k2").alias("_p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    # The children of a common node are on the left of a plain join, which is split.
    return rows.join(
        parents, (F.col("depth") == F.col("_depth")) & (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")), "left"
    ).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums,
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, rebuilt: bool = True, band: int = BAND) -> DataFrame:
    """One row for each distinct opening sequence of turns of ``conversations``.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Turns are ordered by turn,
    NULL first, tied ones by the digest of role and text; NULL role or text counts as empty. Rows
    without conv_id belong to no conversation and are left out; a repeated row is one more turn.
    With ``rebuilt`` each conversation first takes its family's opening. Other columns are not
    read; an empty table has no members, so not even a root.
    """
    turns = original_turns(conversations)
    return trie(*(with_family_opening(turns) if rebuilt else as_they_are(turns)), band)
