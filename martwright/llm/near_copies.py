"""Near copies by shared word shingles: bands propose groups, a trie walk pairs, exact Jaccard decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.bitmaps import split_by_bitmap
from martwright.llm.common import arrow_map, as_bytes, shuffle_width, stored
from martwright.llm.components import components
from martwright.llm.ranks import ranked
from martwright.llm.simhash import trie_links
from martwright.llm.word_windows import mixed, pieces, runs_of

WIDTH = 5
SIMILARITY = 0.8
# Two texts of similarity s share no band with probability (1 - s^ROWS)^BANDS: 0.00003 at 0.8,
# 0.59 at 0.5, 0.98 at 0.3.
BANDS = 34
ROWS = 6
# Differing bits of two fingerprints at similarity 0.8: 9.7 on average, 2.9 as the deviation.
BUDGET = 24
# A chunk of a group holds texts of so many shingles in all, each counted as 200 more.
CHUNK_WEIGHT = 1 << 17
_TEXT_WEIGHT = 200
_ROUNDS = 8
_BINS = BANDS * ROWS
_LARGE = 1 << 12

_SALTS = np.random.default_rng(42).integers(0, 1 << 63, _ROUNDS + _BINS, dtype=np.uint64)
_FULL = np.uint64((1 << 64) - 1)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit numbers of the word shingles of each text.

    Words are those of ``simhash.fingerprint``; fewer than ``width`` make one shingle, none too.
    """
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for piece in pieces([t.lower() for t in texts], width - 1):
        if not len(piece.text):
            continue
        edges = np.flatnonzero(np.r_[True, piece.text[1:] != piece.text[:-1]])
        runs = runs_of(piece.lanes[0], width, 0) if len(piece.text) >= width else piece.lanes[0][:0]
        for low, high in zip(edges, np.r_[edges[1:], len(piece.text)]):
            text, words = piece.text[low], high - low
            if words >= width:
                found[text].append(runs[low : high - width + 1])
            elif piece.place[low] == 0 and piece.sizes[text] == words:
                found[text].append(runs_of(piece.lanes[0][low:high], words, 0) + np.uint64(words))
    return [np.unique(np.concatenate(x)) if x else np.zeros(1, np.uint64) for x in found]


def _thrown(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return mixed(hashes[:, None] ^ salts[None, :], salts[None, :], 0)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One value per bin; two sets agree in a bin with their similarity as the probability.

    In each of some rounds every shingle falls into one bin, which keeps the smallest of the
    earliest round. In bins that stay empty all shingles compete.
    """
    low = np.full(_BINS, _FULL)
    step = len(hashes) if len(hashes) > _LARGE else _ROUNDS * len(hashes)
    rounds = 1 if len(hashes) > _LARGE else _ROUNDS
    for start in range(0, _ROUNDS, rounds):
        salts = _SALTS[start : start + rounds]
        x = _thrown(hashes, salts)
        bins = ((x >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
        order = np.arange(start, start + rounds, dtype=np.uint64) << np.uint64(60)
        values = mixed(x, salts[None, :], 1) >> np.uint64(4) | order[None, :]
        np.minimum.at(low, bins.reshape(step), values.reshape(step))
        if (low < _FULL).all():
            return low
    empty = np.flatnonzero(low == _FULL)
    for start in range(0, len(hashes), _LARGE):
        x = _thrown(hashes[start : start + _LARGE], _SALTS[_ROUNDS + empty])
        low[empty] = np.minimum(low[empty], x.min(axis=0))
    return low


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band, equal where all its values are; keys of different bands differ."""
    rows = values.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mixed(keys, rows[:, i], 0)
    return keys


def majority(hashes: np.ndarray) -> np.uint64:
    """Fingerprint of a set: each bit as in more than half of its numbers."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


_SIGNS = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("keys", pa.binary())])
_SIGNS_DDL = "n1 long, n2 long, fp long, size long, keys binary"


def _signs(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        sets = shingle_sets([x.as_py() for x in rows.column("text")], width)
        if not sets:
            continue
        prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        keys = [band_keys(sketch(s)).tobytes() for s in sets]
        columns = [rows.column("n1"), rows.column("n2"), prints, [len(s) for s in sets], keys]
        columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SIGNS)]
        yield pa.RecordBatch.from_arrays(columns, schema=_SIGNS)


_KEYS = pa.schema([("id", pa.int64()), ("key", pa.int64())])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        keys = np.frombuffer(b"".join(x.as_py() for x in rows.column("keys")), np.int64)
        ids = np.repeat(rows.column("id").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys)], schema=_KEYS)


def near_pairs(
    sets: list[np.ndarray], prints: np.ndarray, chunks: np.ndarray, least: float, budget: int = BUDGET
) -> Iterator[tuple[int, int]]:
    """Pairs of at least the similarity that connect all such pairs of a group.

    The binary-trie walk over the fingerprints proposes the pairs within ``budget`` bits; where
    there are two chunks, only pairs between them. Pairs already connected are skipped.
    """
    values, of = np.unique(prints, return_inverse=True)
    members = [np.flatnonzero(of == i) for i in range(len(values))]
    across = len(np.unique(chunks)) > 1
    partners: list[list[int]] = [[] for _ in sets]

    def propose(a: np.ndarray, b: np.ndarray) -> None:
        for i in a:
            partners[i].extend(j for j in b if i != j and not (across and chunks[i] == chunks[j]))

    for group in members:
        if len(group) > 1:
            for n, i in enumerate(group[:-1]):
                propose([i], group[n + 1 :])
    for a, b in trie_links(values, [(0, len(values))], 0, budget):
        for i, j in zip(a.tolist(), b.tolist()):
            propose(members[i], members[j])
    sizes = np.array([len(s) for s in sets])
    _, words = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    words = [words[e - n : e] for e, n in zip(ends, sizes)]
    marked = np.zeros(max(int(w.max()) for w in words) + 1, bool)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # A text near many others connects them soon.
    for i in sorted(range(len(sets)), key=lambda i: -len(partners[i])):
        own = find(i)
        js = [j for j in partners[i] if find(j) != own]
        js = [j for j in js if min(sizes[i], sizes[j]) >= (least - 1e-9) * max(sizes[i], sizes[j])]
        if not js:
            continue
        marked[words[i]] = True
        starts = np.cumsum([0, *(sizes[j] for j in js[:-1])])
        shared = np.add.reduceat(marked[np.concatenate([words[j] for j in js])].astype(np.int64), starts)
        marked[words[i]] = False
        alike = shared >= (least - 1e-12) * (sizes[i] + sizes[js] - shared)
        for j in np.array(js)[alike].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield i, j


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_UNIT = ["unit", "low", "high"]


def _verified(width: int, least: float, budget: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows sorted by unit; a unit holds two chunks at most."""
    unpack = zstandard.ZstdDecompressor().decompress

    def edges(rows: list[tuple]) -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        sets = shingle_sets([unpack(r[3]) for r in rows], width)
        prints = np.array([r[2] for r in rows], np.int64).view(np.uint64)
        pairs = near_pairs(sets, prints, np.array([r[1] for r in rows]), least, budget)
        found = [(ids[i], ids[j]) for i, j in pairs]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=_EDGES)

    held: list[tuple] = []
    unit = None
    for rows in batches:
        here = zip(*(rows.column(c).to_pylist() for c in _UNIT))
        for key, row in zip(here, zip(*(rows.column(c).to_pylist() for c in ("id", "chunk", "fp", "z")))):
            if key != unit:
                if len(held) > 1:
                    yield edges(held)
                unit, held = key, []
            held.append(row)
    if len(held) > 1:
        yield edges(held)


def _text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("n1"), F.xxhash64(F.lit("second"), text).alias("n2")]


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for rows in batches:
        packed = pa.array([packer.compress(x.as_py()) for x in rows.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("n1"), rows.column("n2"), packed], names=["n1", "n2", "z"])


def nodes_of(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct texts ``id, n1, n2, fp, size, keys``, stored."""
    texts = docs.select(as_bytes()).select(*_text_keys(F.col("text")), "text")
    signs = arrow_map(texts, partial(_signs, width), _SIGNS_DDL)
    once = signs.groupBy("n1", "n2").agg(*(F.first(c).alias(c) for c in ("fp", "size", "keys")))
    return stored(once.withColumn("id", F.monotonically_increasing_id()), "texts")


def _chunked(rows: DataFrame, group: str) -> DataFrame:
    """Rows of one of a group's pairs of chunks: each goes to as many units as there are chunks."""
    numbered = ranked(rows, [group], [F.col("id").asc()], ("weight",))
    chunk = F.floor((F.col("_sum_weight") - F.col("weight")) / F.lit(CHUNK_WEIGHT))
    numbered = stored(numbered.select(F.col(group).alias("unit"), "id", chunk.alias("chunk")), "chunks")
    last = numbered.groupBy(F.col("unit").alias("_unit")).agg(F.max("chunk").alias("_last"))
    rows = numbered.join(last, numbered["unit"] == last["_unit"])
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    return rows.select(
        "unit", F.least("chunk", "_other").alias("low"), F.greatest("chunk", "_other").alias("high"), "id", "chunk"
    )


def units_of(nodes: DataFrame) -> DataFrame | None:
    """``unit, low, high, id, chunk``: tasks in which all texts that share a band meet.

    Texts connected by shared bands form a group. A group is cut into chunks, and each pair of
    chunks is a task; or its bands' buckets are cut so, if that moves fewer rows. Either way
    every two texts of a bucket meet, whatever its size, and no task holds more than two chunks.
    """
    keys = arrow_map(nodes.select("id", "keys"), _opened, "id long, key long")
    firsts = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    firsts = firsts.filter("first <> last").select(F.col("key").alias("_key"), "first")
    weight = (F.col("size") + _TEXT_WEIGHT).alias("weight")
    # A bucket with very many texts is on the left of a plain join, which is split.
    shared = stored(keys.join(firsts, keys["key"] == firsts["_key"]).select("key", "id", "first"), "shared")
    roots = components(shared.select(F.col("first").alias("a"), F.col("id").alias("b")))
    if roots.isEmpty():
        return None
    weights = nodes.select(F.col("id").alias("_id"), weight)
    member = roots.join(weights, roots["node"] == weights["_id"]).select(F.col("node").alias("id"), "root", "weight")
    member = stored(member, "groups")
    chunks = F.ceil(F.sum("weight") / F.lit(CHUNK_WEIGHT))
    whole = member.groupBy("root").agg((F.count(F.lit(1)) * chunks).alias("whole"), chunks.alias("chunks"))
    small = member.join(whole.filter("chunks = 1").select("root"), "root")
    zero = F.lit(0).cast("long")
    units = small.select(F.col("root").alias("unit"), zero.alias("low"), zero.alias("high"), "id", zero.alias("chunk"))
    large = stored(whole.filter("chunks > 1"), "large")
    if large.isEmpty():
        return units
    inner = shared.join(member.join(large, "root").select("id", "root", "weight", "whole"), "id")
    inner = stored(inner.select("key", "id", "root", "weight", "whole"), "buckets")
    by_key = inner.groupBy("key", "root", "whole").agg((F.count(F.lit(1)) * chunks).alias("rows"))
    by_group = by_key.groupBy("root", "whole").agg(F.sum("rows").alias("rows"))
    apart = by_group.filter("rows < whole").select("root")
    together = by_group.filter("rows >= whole").select("root")
    for frame, group, chosen in ((member, "root", together), (inner, "key", apart)):
        units = units.unionByName(_chunked(frame.join(chosen, "root").select(group, "id", "weight"), group))
    return units


def links(docs: DataFrame, nodes: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """Edges ``(a, b)`` between ids of texts whose shingle sets reach the similarity.

    They connect all such texts that share a band and whose fingerprints lie within ``BUDGET`` bits.
    """
    units = units_of(nodes)
    if units is None:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    units = stored(units, "units")
    wanted = units.select("id").distinct().join(nodes.select("id", "n1", "n2", "fp"), "id")
    wanted = stored(wanted, "wanted")
    texts = docs.select(as_bytes()).select(*_text_keys(F.col("text")), "text")
    near, _ = split_by_bitmap(texts, wanted, "n1")
    packed = arrow_map(near, _squeeze, "n1 long, n2 long, z binary")
    packed = packed.join(wanted.hint("merge"), ["n1", "n2"]).groupBy("id", "fp").agg(F.first("z").alias("z"))
    dealt = units.join(packed, "id").select(*_UNIT, "id", "chunk", "fp", "z")
    dealt = dealt.repartition(shuffle_width(docs.sparkSession), *_UNIT).sortWithinPartitions(*_UNIT, "id")
    return stored(arrow_map(dealt, partial(_verified, width, least, BUDGET), "a long, b long"), "near")


def keep_one(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The documents themselves, one of each group of near copies: the smallest doc_id.

    Texts are near if their word shingles have a Jaccard similarity of ``least`` or more, and
    groups are the components of such pairs. NULL counts as empty; texts without a word are near
    each other, and so are equal ones. Rows without doc_id always stay, and so do rows that share
    the smallest doc_id of their group. Other columns are carried along; an empty table stays so.
    """
    nodes = nodes_of(docs, width)
    roots = components(links(docs, nodes, width, least))
    ids = nodes.select("id", "n1", "n2")
    top = ids.select(F.col("id").alias("root"), F.col("n1").alias("g1"), F.col("n2").alias("g2"))
    linked = roots.join(ids, roots["node"] == ids["id"]).select("root", F.col("n1").alias("_n1"), F.col("n2").alias("_n2"))
    linked = linked.join(top, "root").select("_n1", "_n2", "g1", "g2")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(text)).distinct()
    rows = rows.join(linked, (rows["n1"] == linked["_n1"]) & (rows["n2"] == linked["_n2"]), "left")
    group = stored(rows.select("doc_id", F.coalesce("g1", "n1").alias("g1"), F.coalesce("g2", "n2").alias("g2")), "rows")
    found = group.join(group.groupBy("g1", "g2").agg(F.min("doc_id").alias("first")), ["g1", "g2"])
    found = stored(found.filter("doc_id is not null").select("doc_id", "first"), "firsts")
    drop = found.filter("doc_id <> first").select("doc_id").distinct()
    stay = found.filter("doc_id = first").select("doc_id").distinct()
    # A repeated doc_id with different texts can be first in one group and later in another.
    drop = stored(drop.join(stay, "doc_id", "left_anti"), "drop")
    maybe, others = split_by_bitmap(docs, drop, "doc_id")
    gone = drop.select(F.col("doc_id").alias("_gone"))
    kept = maybe.join(gone, maybe["doc_id"] == gone["_gone"], "left_anti")
    return others.unionByName(kept).select(*docs.columns)
