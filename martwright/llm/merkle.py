"""Merkle manifest of a dataset: a tree per source, a tree over the sources, and pointer-jumping proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, shuffle_width, stored
from martwright.llm.ranks import ranked, same

ARITY = 3
# Levels hashed in one round: a task holds blocks of 3^5 digests.
LEVELS_PER_ROUND = 5
# Nodes above the leaves are broadcast while they are surely smaller than this.
BROADCAST_BYTES = 8 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Number of the tree whose leaves are the sources' roots.
_TOP = -1


def height(leaves: int, arity: int = ARITY) -> int:
    """Levels between a leaf and the root; the same for all leaves."""
    levels, reach = 0, 1
    while reach < leaves:
        levels, reach = levels + 1, reach * arity
    return levels


def digest(*fields: Column) -> Column:
    """SHA-256 (binary) of the fields: ``-`` for NULL, else byte count, ``:`` and the value."""
    framed = [
        F.when(c.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
        )
        for c in fields
    ]
    return F.unhex(F.sha2(F.concat(*framed).cast("binary"), 256))


def document_digest(**changed: Column) -> Column:
    """Leaf of a documents row; named columns may be replaced."""
    return digest(*(changed.get(c, F.col(c)) for c in FIELDS))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def fold(leaf: Column, steps: Column) -> Column:
    """Root (hex) that a leaf (binary) has with the siblings on its way."""
    return F.aggregate(
        steps,
        _hex(leaf),
        lambda held, s: F.sha2(F.concat(_hex(s["l"]), held, _hex(s["r"])).cast("binary"), 256),
    )


def proof_digest(steps: Column) -> Column:
    """SHA-256 (hex) of all siblings, level by level, left to right."""
    sides = F.transform(steps, lambda s: F.concat(_hex(s["l"]), _hex(s["r"])))
    return F.sha2(F.concat_ws("", sides).cast("binary"), 256)


_NODES = pa.schema(
    [
        ("tree", pa.int64()),
        ("level", pa.int32()),
        ("idx", pa.int64()),
        ("n", pa.int64()),
        ("digest", pa.binary()),
        ("l", pa.binary()),
        ("r", pa.binary()),
        ("top", pa.bool_()),
        ("doc_id", pa.int64()),
        ("other", pa.binary()),
    ]
)
_NODES_DDL = (
    "tree long, level int, idx long, n long, digest binary, l binary, r binary, top boolean, "
    "doc_id long, other binary"
)


def _block(rows: list[tuple], arity: int, levels: int) -> list[tuple]:
    """Nodes of an aligned block: children with their siblings, and what is left on top."""
    tree, level, first, n = rows[0][:4]
    high = height(n, arity)
    nodes = [(row[4], row[8], row[9]) for row in rows]
    out = []
    for level in range(level, min(level + levels, high)):
        parents = []
        for at in range(0, len(nodes), arity):
            run = [x[0] for x in nodes[at : at + arity]]
            for i, (own, doc_id, other) in enumerate(nodes[at : at + arity]):
                left, right = b"".join(run[:i]), b"".join(run[i + 1 :])
                out.append((tree, level, first + at + i, n, own, left, right, False, doc_id, other))
            text = "".join(x.hex() for x in run).encode()
            parents.append((hashlib.sha256(text).digest(), None, None))
        nodes, first, level = parents, first // arity, level + 1
    for i, (own, doc_id, other) in enumerate(nodes):
        out.append((tree, level, first + i, n, own, None, None, level == high, doc_id, other))
    return out


def _hash_up(arity: int, levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tree and idx; blocks may span batches."""
    size = arity**levels
    held: list[tuple] = []
    out: list[tuple] = []

    def flushed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES
        )

    for rows in batches:
        for row in zip(*(rows.column(c).to_pylist() for c in _NODES.names)):
            if held and (held[0][0], held[0][2] // size) != (row[0], row[2] // size):
                out += _block(held, arity, levels)
                held = []
            held.append(row)
        if len(out) >= 1 << 14:
            yield flushed(out)
            out = []
    if held:
        out += _block(held, arity, levels)
    if out:
        yield flushed(out)


def _grow(leaves: DataFrame, high: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """All nodes below the roots, and the roots, of trees of at most ``high`` levels."""
    width = shuffle_width(leaves.sparkSession)
    size = arity**LEVELS_PER_ROUND
    below, tops, open_rows = [], [], leaves
    for _ in range(max(-(-high // LEVELS_PER_ROUND), 1)):
        dealt = open_rows.repartition(width, "tree", F.floor(F.col("idx") / size))
        found = stored(
            arrow_map(
                dealt.sortWithinPartitions("tree", "idx").select(*_NODES.names),
                partial(_hash_up, arity, LEVELS_PER_ROUND),
                _NODES_DDL,
            ),
            "nodes",
        )
        below.append(found.filter("l is not null"))
        tops.append(found.filter("top"))
        open_rows = found.filter("l is null and not top")
    joined = below[0], tops[0]
    for more in zip(below[1:], tops[1:]):
        joined = joined[0].unionByName(more[0]), joined[1].unionByName(more[1])
    return joined


def _jump(rows: DataFrame, upper: DataFrame, small: bool) -> DataFrame:
    """Every row's pointer moved on to where the node pointed at points, siblings appended."""
    to = upper.select(
        *(F.col(c).alias(f"_{c}") for c in ("tree", "level", "idx")),
        *(F.col(c).alias(f"_{c}") for c in ("p_tree", "p_level", "p_idx", "steps", "sub")),
    )
    here = [rows[f"p_{c}"] == to[f"_{c}"] for c in ("tree", "level", "idx")]
    return rows.join(F.broadcast(to) if small else to, here, "left").select(
        *(c for c in rows.columns if c not in ("p_tree", "p_level", "p_idx", "steps", "sub")),
        *(F.col(f"_p_{c}").alias(f"p_{c}") for c in ("tree", "level", "idx")),
        F.when(F.col("_steps").isNull(), F.col("steps"))
        .otherwise(F.concat("steps", "_steps"))
        .alias("steps"),
        F.coalesce("sub", "_sub").alias("sub"),
    )


@dataclass(frozen=True)
class Manifest:
    """Root of a dataset (hex; None if it has no rows) and one proof for each row.

    ``proofs`` has ``doc_id``, ``leaf``, ``other`` and ``subroot`` (binary) and ``steps``, the
    siblings to the left and right on each level up to the root.
    """

    root: str | None
    proofs: DataFrame


def build(leaves: DataFrame, arity: int = ARITY) -> Manifest:
    """Manifest of ``leaves(doc_id, source, leaf, other)``.

    Leaves of a source ascend by doc_id (NULL first; ties by leaf, so it does not matter which
    of two equal rows comes first). While several nodes remain, runs of ``arity`` become their
    hash, a last shorter run as well. The sources' roots (NULL first, then bytewise) go on in
    the same way. ``other`` is a second leaf value that rides along.

    Proofs come from pointer jumping: each node starts with its siblings and a pointer to its
    parent; each round joins the nodes with themselves, appends what the node pointed at holds,
    and doubles the distance. Only nodes that a later round can point at are kept.
    """
    leaves = stored(leaves.select("doc_id", "source", "leaf", "other"), "leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    sources = leaves.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    sources = stored(
        ranked(stored(sources, "sources"), [], [F.col("_source").asc_nulls_first()]).withColumnRenamed(
            "_rank", "tree"
        ),
        "trees",
    )
    most, trees = sources.agg(F.max("n"), F.count(F.lit(1))).first()
    if not trees:
        empty = leaves.select("doc_id", "leaf", "other", F.col("leaf").alias("subroot"))
        return Manifest(None, empty.withColumn("steps", F.expr("cast(array() as array<struct<l:binary,r:binary>>)")))
    placed = ranked(leaves, ["source"], order)
    blank = F.lit(None).cast("binary")
    placed = placed.join(sources, same(placed, sources, ["source"], ["_source"])).select(
        "tree",
        F.lit(0).alias("level"),
        F.col("_rank").alias("idx"),
        "n",
        F.col("leaf").alias("digest"),
        blank.alias("l"),
        blank.alias("r"),
        F.lit(False).alias("top"),
        "doc_id",
        "other",
    )
    high, top_high = height(most, arity), height(trees, arity)
    below, tops = _grow(placed, high, arity)
    over = tops.select(
        F.lit(_TOP).cast("long").alias("tree"),
        F.lit(0).alias("level"),
        F.col("tree").alias("idx"),
        F.lit(trees).cast("long").alias("n"),
        "digest",
        "l",
        "r",
        "top",
        F.lit(None).cast("long").alias("doc_id"),
        blank.alias("other"),
    )
    over_below, over_top = _grow(over, top_high, arity)
    root = over_top.select(F.lower(F.hex("digest"))).first()[0]

    def pointing(rows: DataFrame, tree: Column, level: Column, idx: Column, sub: Column, own: bool) -> DataFrame:
        steps = F.array(F.struct("l", "r")) if own else F.expr("cast(array() as array<struct<l:binary,r:binary>>)")
        return rows.select(
            "tree", "level", "idx", "doc_id", "digest", "other",
            tree.alias("p_tree"), level.alias("p_level"), idx.alias("p_idx"), steps.alias("steps"), sub.alias("sub"),
        )

    up = (F.col("level") + 1, F.floor(F.col("idx") / arity))
    nowhere = F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long")
    nodes = pointing(below, F.col("tree"), *up, blank, True)
    # The root of a source is the leaf of the upper tree: a step without siblings and without hash.
    nodes = nodes.unionByName(
        pointing(tops, F.lit(_TOP).cast("long"), F.lit(0), F.col("tree"), F.col("digest"), False)
    )
    above = pointing(over_below, F.col("tree"), *up, blank, True).unionByName(
        pointing(over_top, *nowhere, blank, False)
    )
    rows = nodes.filter("level = 0")
    upper = nodes.filter("level > 0").unionByName(above).drop("doc_id", "digest", "other")
    distance = 1
    while distance < high + 1 + top_high:
        upper = stored(upper, "upper")
        # Siblings, positions and pointers of a row with so many steps take less than this.
        small = upper.count() * (128 + distance * (arity * 32 + 48)) <= BROADCAST_BYTES
        rows = stored(_jump(rows, upper, small), "jumped")
        distance *= 2
        upper = _jump(upper, upper, small).filter((F.col("tree") == _TOP) | (F.col("level") % distance == 0))
    return Manifest(
        root, rows.select("doc_id", F.col("digest").alias("leaf"), "other", F.col("sub").alias("subroot"), "steps")
    )


def manifest(docs: DataFrame, arity: int = ARITY) -> Manifest:
    """Manifest of a documents table: one leaf per row, all five columns hashed.

    A NULL field is hashed as ``-``, an empty text as ``0:``; a repeated row is a leaf of its
    own. Columns beyond the five are not read. An empty table has no root and no proofs.
    """
    return build(docs.select("doc_id", "source", document_digest().alias("leaf"), F.lit(None).cast("binary").alias("other")), arity)


def tamper_check(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Proofs of all rows, folded from tampered leaves where the checksum of doc_id is even.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per
    row of ``docs``. Tampering deletes line feeds from the text and nothing else; a NULL text
    or doc_id stays as it is. NULLs, empty texts, repeated rows and other columns as in
    ``manifest``; an empty table gives no rows.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    bare = F.when(even & F.col("text").contains("\n"), document_digest(text=F.translate("text", "\n", "")))
    leaf = document_digest()
    built = build(docs.select("doc_id", "source", leaf.alias("leaf"), bare.alias("other")), arity)
    folded = fold(F.coalesce("other", "leaf"), F.col("steps"))
    return built.proofs.select(
        "doc_id",
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        F.lit(built.root).cast("string").alias("root"),
        proof_digest(F.col("steps")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
