"""SimHash near-duplicates: majority fingerprints joined by a pruned binary-trie walk."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, as_bytes, batch, shuffle_width, stored
from martwright.llm.components import components

WORDS_PER_SHINGLE = 3
MAX_BITS = 2
# A bucket of the trie with more fingerprints than this is dealt out by further bits.
BUCKET_ROWS = 1 << 16
_BLOCK = 1 << 16
_FRONTIER = 1 << 18

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, width: int = WORDS_PER_SHINGLE) -> int:
    """64-bit majority of the XXH64 hashes (seed 42) of all word shingles.

    Words are runs without space, tab, line feed, vertical tab, form feed and carriage
    return, with A-Z lower-cased. Fewer words than ``width`` make one shingle; no word
    gives zero. Shingles are hashed in blocks, so very long texts need little memory.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return _hash(b" ".join(words))
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
    counts, total = np.zeros(64, np.int64), len(words) - width + 1
    hashes = map(_hash, shingles)
    for start in range(0, total, _BLOCK):
        block = np.fromiter(hashes, np.uint64, min(_BLOCK, total - start))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _prints(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = np.fromiter(
            (fingerprint(x.as_py(), width) for x in rows.column("text")), np.uint64, rows.num_rows
        )
        yield batch(_PRINTS, doc_id=rows.column("doc_id"), fp=found.view(np.int64))


def fingerprints(docs: DataFrame, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row; the fingerprint is a signed long."""
    return arrow_map(
        docs.select(F.col("doc_id").cast("long"), as_bytes()),
        partial(_prints, width),
        "doc_id long, fp long",
    )


def trie_links(values: np.ndarray, buckets: list[tuple[int, int]], depth: int, budget: int):
    """Yield index pairs of a sorted array of distinct uint64 within ``budget`` bits.

    The array is the leaf row of a binary trie: a node is a range that shares its
    leading bits. The walk starts with each bucket (a range sharing ``depth`` leading
    bits) paired with itself and takes all pairs one bit down together, adding one
    differing bit where the sides part, and dropping pairs beyond the budget. Pairs of
    single leaves are compared at once. Wide fronts are walked in pieces.
    """
    start = np.array([b for b in buckets if b[1] - b[0] > 1], np.int64).reshape(-1, 2)
    zero = np.zeros(len(start), np.int64)
    stack = [(depth, start[:, 0], start[:, 1], start[:, 0], start[:, 1], zero)]
    while stack:
        depth, lo1, hi1, lo2, hi2, cost = stack.pop()
        if len(lo1) > _FRONTIER:
            half = len(lo1) // 2
            for part in (slice(half, None), slice(None, half)):
                stack.append((depth, *(x[part] for x in (lo1, hi1, lo2, hi2, cost))))
            continue
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if leaf.any():
            i, j = lo1[leaf], lo2[leaf]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            lo1, hi1, lo2, hi2, cost = (x[~leaf] for x in (lo1, hi1, lo2, hi2, cost))
        if not len(lo1) or depth >= 64:
            continue
        bit = np.uint64(63 - depth)
        one = np.uint64(1)

        def split(lo, hi):
            target = ((values[lo] >> bit) | one) << bit
            return np.clip(np.searchsorted(values, target), lo, hi)

        mid1, mid2 = split(lo1, hi1), split(lo2, hi2)
        same = lo1 == lo2
        children = [
            (lo1, mid1, lo2, mid2, cost),
            (mid1, hi1, mid2, hi2, cost),
            (lo1, mid1, mid2, hi2, cost + 1),
            tuple(x[~same] for x in (mid1, hi1, lo2, mid2, cost + 1)),
        ]
        front = [np.concatenate(part) for part in zip(*children)]
        keep = (front[1] > front[0]) & (front[3] > front[2]) & (front[4] <= budget)
        keep &= ~((front[0] == front[2]) & (front[1] - front[0] == 1))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in front)))


def _smallest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of the linked indexes; a class's label is its smallest index."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SIGN = np.int64(-(1 << 63))


def _bucket_edges(budget: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows sorted by ``(trie, walked)``; buckets may span batches."""

    def flush(rows: np.ndarray):
        ends = np.flatnonzero((rows[0, 1:] != rows[0, :-1])) + 1
        for lo, hi in zip([0, *ends], [*ends, rows.shape[1]]):
            if hi - lo < 2:
                continue
            bits = int(rows[1, lo])
            values = (rows[2, lo:hi] ^ _SIGN).view(np.uint64)
            fp = rows[3, lo:hi]
            prefix = values >> np.uint64(64 - bits)
            cuts = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            labels = np.arange(hi - lo)
            for i, j in trie_links(
                values, list(zip([0, *cuts], [*cuts, hi - lo])), bits, budget
            ):
                _smallest(labels, i, j)
            moved = np.flatnonzero(labels != np.arange(hi - lo))
            if len(moved):
                yield batch(_EDGES, a=fp[labels[moved]], b=fp[moved])

    held = np.empty((4, 0), np.int64)
    for rows in batches:
        more = [rows.column(c).to_numpy() for c in ("trie", "prefix_bits", "walked", "fp")]
        held = np.concatenate([held, np.stack(more).astype(np.int64)], axis=1)
        if not held.shape[1]:
            continue
        # The last bucket may go on in the next batch.
        shift = np.uint64(64 - int(held[1, -1]))
        bucket = (held[2] ^ _SIGN).view(np.uint64) >> shift
        open_from = int(np.argmax((held[0] == held[0, -1]) & (bucket == bucket[-1])))
        yield from flush(held[:, :open_from])
        held = held[:, open_from:]
    yield from flush(held)


def _permuted(value: Column, order: list[int]) -> Column:
    """The 64 bits of a long in another order; bit 0 is the highest."""
    out, at, done = F.lit(0).cast("long"), 0, 0
    while at < 64:
        end = at + 1
        while end < 64 and order[end] == order[end - 1] + 1:
            end += 1
        size = end - at
        field = F.shiftrightunsigned(F.shiftleft(value, order[at]), 64 - size)
        done += size
        out = out.bitwiseOR(F.shiftleft(field, 64 - done))
        at = end
    return out


def _split(bits: list[int], parts: int) -> list[list[int]]:
    size, more = divmod(len(bits), parts)
    ends = [i * size + min(i, more) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:])]


def _trie_rows(prints: DataFrame, tries: list[tuple[int, int, list[int]]]) -> DataFrame:
    """One row for each fingerprint and trie ``(number, prefix bits, bit order)``."""
    sides = []
    for number, bits, order in tries:
        walked = _permuted(F.col("fp"), order)
        sides.append(
            F.struct(
                F.lit(number).alias("trie"),
                F.lit(bits).alias("prefix_bits"),
                # Flipped sign: signed order is then the order of the bits.
                walked.bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("walked"),
                F.shiftrightunsigned(walked, 64 - bits).alias("bucket"),
            )
        )
    return prints.select("fp", F.explode(F.array(*sides)).alias("t")).select("fp", "t.*")


def links(prints: DataFrame, budget: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints within ``budget`` bits.

    Two values with at most ``budget`` differing bits agree on one of ``budget + 1``
    blocks of bits. Each block in turn comes first and is the root level of a trie, whose
    subtrees are dealt out by that block and walked against themselves. As long as a subtree
    holds more than ``bucket_rows`` values it is dealt out again in the same way by blocks of its
    remaining bits, so near copies by the million do not meet in one task: after four times
    at most 16 bits are left, and 65,536 values. Within a subtree the linked values come back
    as a star on the smallest; pairs are not kept.
    """

    def tries_of(known: list[int], start: int) -> list[tuple[int, int, list[int]]]:
        rest = [b for b in range(64) if b not in known]
        parts = _split(rest, budget + 1) if len(rest) > budget else []
        return [
            (start + i, len(known) + len(part), known + part + [b for b in rest if b not in part])
            for i, part in enumerate(parts)
        ]

    tries = tries_of([], 0)
    rows = stored(_trie_rows(prints.select("fp").distinct(), tries), "trie")
    every, numbers = None, len(tries)
    while True:
        large = rows.groupBy("trie", "bucket").agg(F.count(F.lit(1)).alias("_n"))
        open_ = [number for number, bits, _ in tries if 64 - bits > budget]
        large = large.filter((F.col("_n") > bucket_rows) & F.col("trie").isin(open_)).select("trie", "bucket")
        small = rows.join(large, ["trie", "bucket"], "left_anti").select(*rows.columns)
        every = small if every is None else every.unionByName(small)
        hot = stored(rows.join(large, ["trie", "bucket"], "left_semi").select("fp", "trie"), "hot")
        # As many numbers as tries at most.
        dealt_again = {r["trie"] for r in hot.select("trie").distinct().collect()}
        if not dealt_again:
            break
        more, found = [], None
        for number, bits, order in tries:
            if number in dealt_again:
                inner = tries_of(order[:bits], numbers)
                numbers += len(inner)
                more += inner
                part = _trie_rows(hot.filter(F.col("trie") == number).select("fp"), inner)
                found = part if found is None else found.unionByName(part)
        tries, rows = more, stored(found, "trie")
    dealt = every.repartition(shuffle_width(prints.sparkSession), "trie", "bucket")
    return arrow_map(
        dealt.sortWithinPartitions("trie", "walked").select("trie", "prefix_bits", "walked", "fp"),
        partial(_bucket_edges, budget),
        "a long, b long",
    )


def near_duplicates(
    docs: DataFrame, width: int = WORDS_PER_SHINGLE, budget: int = MAX_BITS
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest doc_id
    reachable over links of at most ``budget`` differing bits. Equal fingerprints link.
    NULL and empty texts have fingerprint zero and link like any other. A repeated row
    is returned as often as it came. A NULL doc_id is returned as NULL, and counts only
    where a class has no other: its component_id is then NULL. Other columns are not
    read. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, width), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints, budget))
    # Classes without a link are their own component; the rest take their root's minimum.
    linked = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = linked.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_class, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = WORDS_PER_SHINGLE, budget: int = MAX_BITS) -> DataFrame:
    """The documents themselves, one of each near-duplicate group: the smallest doc_id.

    Rows and columns are otherwise unchanged. Rows that share the smallest doc_id of
    their group all stay, unless they are equal in full; exact copies of a row are for
    exact deduplication. Rows without doc_id always stay.
    """
    found = near_duplicates(docs, width, budget)
    drop = found.filter("doc_id <> component_id").select("doc_id").distinct()
    stay = found.filter("doc_id = component_id").select("doc_id").distinct()
    # A repeated doc_id with different texts can be first in one group and later in another.
    drop = drop.join(stay, "doc_id", "left_anti")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
