"""Removal of long repeated byte strings by suffix sorting of aligned text blocks."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.llm.common import arrow_map, as_bytes, shuffle_width, stored
from martwright.llm.suffix_sort import Buffer

LENGTH = 200
# Bytes hashed at each position; every string of LENGTH bytes holds LENGTH - GRAM + 1 of them.
GRAM = 48
# A bucket of blocks to be sorted together that has more of them is dealt out by further bytes.
VARIANTS = 1 << 10
_CHUNK = 1 << 18
_SORT = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = _CHUNK + 4 * LENGTH
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return out[0], out[1]


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    power, inverse = _powers()
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
    found = (sums[gram:] - sums[:-gram]) * inverse[: len(text) - gram + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


def anchors(data: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """``(start, count, hash)`` of runs of string starts that share an anchor.

    A string's anchor is its gram with the smallest hash, the first of several. That depends on
    the string alone, so equal strings have the same anchor at the same place.
    """
    window = length - gram + 1
    for base in range(0, max(0, len(data) - length + 1), _CHUNK):
        text = np.frombuffer(data, np.uint8, min(_CHUNK + length - 1, len(data) - base), base)
        hashes = _gram_hashes(text, gram)
        places = np.arange(len(hashes), dtype=np.uint64)
        value = (hashes & ~_PLACE) | places
        # Sliding minimum: from the right end of one block and the left end of the next.
        full = -(-len(value) // window) * window
        padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(value)] = value
        grid = padded.reshape(-1, window)
        right = np.minimum.accumulate(grid, axis=1).ravel()
        left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(value) - window + 1
        owner = (np.minimum(left[:n], right[window - 1 : window - 1 + n]) & _PLACE).astype(np.int64)
        starts = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1]
        counts = np.diff(np.r_[starts, n])
        found = hashes[owner[starts]].view(np.int64)
        yield from zip((starts + base).tolist(), counts.tolist(), found.tolist())


_BLOCKS = pa.schema(
    [
        ("kid", pa.int64()),
        ("th", pa.int64()),
        ("h", pa.int64()),
        ("d", pa.int64()),
        ("n", pa.int32()),
        ("at", pa.binary()),
        ("times", pa.int32()),
    ]
)
_BLOCKS_DDL = "kid long, th long, h long, d long, n int, at binary, times int"


def _block_rows(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for rows in batches:
        out: list[list] = [[] for _ in _BLOCKS]
        for kid, th, text in zip(
            rows.column("kid").to_pylist(), rows.column("th").to_pylist(), rows.column("text")
        ):
            data = text.as_py()
            if len(data) < length:
                continue
            view = memoryview(data)
            # Blocks that repeat inside a document are one row.
            seen: dict[tuple, list[int]] = defaultdict(list)
            for start, count, h in anchors(data, length, gram):
                seen[h, digest(view[start : start + count + length - 1]), count].append(start)
            for (h, d, count), at in seen.items():
                d = d - (1 << 64) if d >> 63 else d
                row = (kid, th, h, d, count, np.array(at, ">i4").tobytes(), len(at))
                for column, value in zip(out, row):
                    column.append(value)
            if len(out[0]) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _BLOCKS)], schema=_BLOCKS)
                out = [[] for _ in _BLOCKS]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _BLOCKS)], schema=_BLOCKS)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, kid, th, text``: rows with the same key have the same text, so the same result."""
    rows = docs.select(F.col("doc_id").cast("long"), as_bytes())
    return rows.select(
        "doc_id", F.coalesce("doc_id", F.lit(-1)).alias("kid"), F.xxhash64("text").alias("th"), "text"
    )


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for rows in batches:
        packed = pa.array([packer.compress(x.as_py()) for x in rows.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in ("doc_id", "kid", "th")), packed], names=["doc_id", "kid", "th", "z"]
        )


def _squeezed(docs: DataFrame) -> DataFrame:
    """Compressed texts, for shuffles."""
    return arrow_map(_keyed(docs), _squeeze, "doc_id long, kid long, th long, z binary")


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


_VARIANT_DDL = "h long, d long, n int, block binary"


def _variants(rows: list[tuple]) -> pa.RecordBatch:
    h, d, n, block = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(block, pa.binary())],
        names=["h", "d", "n", "block"],
    )


def _cut_blocks(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out: list[tuple] = []
        for z, wanted in zip(rows.column("z"), rows.column("wanted")):
            data = _unpack(z.as_py())
            for w in wanted.as_py():
                out.append((w["h"], w["d"], w["n"], data[w["at"] : w["at"] + w["n"] + length - 1]))
            if len(out) >= 1 << 15:
                yield _variants(out)
                out = []
        if out:
            yield _variants(out)


_FOUND = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_FOUND_DDL = "h long, d long, first int, last int"


def repeated_runs(blocks: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(block, first, last)`` of the runs of strings that occur more than once in the blocks.

    Block i holds ``counts[i]`` strings of ``length`` bytes. Their suffixes are sorted in two
    stages; those that share ``length`` bytes with a neighbour are repeated.
    """
    sizes = np.array([len(b) for b in blocks], np.int64)
    bases = np.cumsum(sizes) - sizes
    buffer = Buffer(b"".join(blocks), length)
    edge = np.zeros(buffer.size + 1, np.int64)
    edge[bases] += 1
    np.add.at(edge, bases + counts, -1)
    wanted = np.cumsum(edge[:-1]) > 0
    order = buffer.two_stage_sort(wanted)
    hit = np.zeros(buffer.size + 1, bool)
    if len(order):
        hit[order[buffer.equal_neighbours(order)]] = True
    # A run of hits ends with its block: the bytes after the last string are never wanted.
    first = np.flatnonzero(hit[:-1] & ~np.r_[False, hit[:-2]])
    last = np.flatnonzero(hit[:-1] & ~hit[1:])
    block = np.searchsorted(bases, first, side="right") - 1
    return block, first - bases[block], last - bases[block]


def _sort_blocks(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket; all blocks of a bucket are sorted together."""

    def flush(tables: list[pa.Table]):
        rows = pa.concat_tables(tables)
        counts = rows.column("n").to_numpy().astype(np.int64)
        base = rows.column("base").to_numpy().astype(np.int64)
        block, first, last = repeated_runs(rows.column("block").to_pylist(), counts, length)
        if len(block):
            at = pa.array(block)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("h").take(at).combine_chunks(),
                    rows.column("d").take(at).combine_chunks(),
                    pa.array(first + base[block], pa.int32()),
                    pa.array(last + base[block], pa.int32()),
                ],
                schema=_FOUND,
            )

    held: list[pa.Table] = []
    size, last = 0, None
    for rows in batches:
        table = pa.Table.from_batches([rows])
        h = table.column("bucket").to_numpy()
        cuts = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
        counts = np.add.reduceat(table.column("n").to_numpy(), cuts) if len(h) else []
        done = 0
        for cut, count in zip(cuts, counts):
            if size >= _SORT and h[cut] != last:
                if cut > done:
                    held.append(table.slice(done, cut - done))
                yield from flush(held)
                held, size, done = [], 0, cut
            size += count
            last = h[cut]
        if table.num_rows > done:
            held.append(table.slice(done))
    if held:
        yield from flush(held)


_ITEMS = pa.schema(
    [
        ("bucket", pa.int64()),
        ("low", pa.int32()),
        ("high", pa.int32()),
        ("h", pa.int64()),
        ("d", pa.int64()),
        ("base", pa.int32()),
        ("n", pa.int32()),
        ("anchor", pa.int32()),
        ("block", pa.binary()),
        ("same", pa.binary()),
    ]
)
_ITEMS_DDL = (
    "bucket long, low int, high int, h long, d long, base int, n int, anchor int, block binary, same binary"
)


def _items(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ITEMS)], schema=_ITEMS)


def _first_items(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole blocks in the bucket of their anchor, with the anchor's place."""
    for rows in batches:
        out = []
        for h, d, n, block in zip(*(rows.column(c).to_pylist() for c in ("h", "d", "n", "block"))):
            hashes = _gram_hashes(np.frombuffer(block, np.uint8), gram).view(np.int64)
            # The anchor lies inside every string of the block.
            anchor = n - 1 + int(np.argmax(hashes[n - 1 : length - gram + 1] == h))
            out.append((h, 0, length - gram, h, d, 0, n, anchor, block, b""))
        if out:
            yield _items(out)


def _halved(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of each item, dealt out by how far before the anchor they start.

    Those that start ``middle`` bytes before it or earlier all hold these bytes, the others
    some more bytes behind the anchor; these bytes go into the new bucket's number. Equal
    strings start equally far before their anchor and hold the same bytes, so they meet again.
    """
    digest, same = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
    for rows in batches:
        out = []
        for bucket, low, high, h, d, base, n, anchor, block, _ in zip(
            *(rows.column(c).to_pylist() for c in _ITEMS.names)
        ):
            middle = (low + high + 1) // 2
            # Strings first to last of the item start at least, or less than, middle before the anchor.
            cut = min(max(anchor - middle + 1, 0), n)
            seed = bucket & (1 << 64) - 1
            for first, end, a, b, low_, high_ in (
                (0, cut, anchor - middle, anchor, middle, high),
                (cut, n, anchor + gram, anchor + length - middle + 1, low, middle - 1),
            ):
                if first == end:
                    continue
                number = digest(block[a:b], seed=seed ^ (high_ + 1))
                part = block[first : end - 1 + length]
                out.append(
                    (number - (1 << 64) if number >> 63 else number, low_, high_, h, d, base + first, end - first)
                    + (anchor - first, part, same(part))
                )
        if out:
            yield _items(out)


def _sorted_runs(blocks: DataFrame, length: int, gram: int, variants: int) -> DataFrame:
    """Runs ``(h, d, first, last)`` of strings that different blocks of one anchor share.

    Blocks of an anchor form a bucket. As long as a bucket holds more than ``variants`` blocks
    it is dealt out by the bytes around the anchor, half of the strings by those before and half
    by those behind it; parts that became equal are settled and one of them goes on. After
    eight rounds a bucket holds one string, so every bucket gets small. All buckets are sorted.
    """
    items = stored(arrow_map(blocks, partial(_first_items, length, gram), _ITEMS_DDL), "items")
    settled: list[DataFrame] = []
    ready: list[DataFrame] = []
    while True:
        sizes = items.groupBy("bucket", "low", "high").agg(F.count(F.lit(1)).alias("_n"))
        crowded = stored(sizes.filter((F.col("_n") > variants) & (F.col("low") < F.col("high"))), "crowded")
        if crowded.isEmpty():
            break
        key = ["bucket", "low", "high"]
        ready.append(items.join(crowded, key, "left_anti"))
        halves = arrow_map(
            items.join(crowded, key, "left_semi").select(*_ITEMS.names), partial(_halved, length, gram), _ITEMS_DDL
        )
        halves = stored(halves, "halves")
        kinds = halves.groupBy(*key, "same", "n").agg(
            F.count(F.lit(1)).alias("_n"), F.min(F.struct("h", "d")).alias("_one")
        )
        halves = stored(halves.join(kinds, [*key, "same", "n"]), "dealt")
        settled.append(
            halves.filter("_n > 1").select("h", "d", F.col("base").alias("first"), (F.col("base") + F.col("n") - 1).alias("last"))
        )
        items = halves.filter("h = _one.h and d = _one.d").select(*_ITEMS.names)
    for more in ready:
        items = items.unionByName(more)
    dealt = items.select("bucket", "low", "high", "h", "d", "base", "n", "block")
    dealt = dealt.repartition(shuffle_width(blocks.sparkSession), "bucket").sortWithinPartitions("bucket", "low")
    found = arrow_map(dealt, partial(_sort_blocks, length), _FOUND_DDL)
    for more in settled:
        found = found.unionByName(more)
    return found


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, variants: int = VARIANTS
) -> DataFrame:
    """``(kid, th, spans)``: for each text with repeats, pieces ``(at, first, last)``.

    Each piece says: from every position in ``at``, the strings number ``first`` to ``last``
    also start elsewhere. ``kid`` and ``th`` are the document's key (see ``_keyed``).

    1. Each text falls into blocks, runs of string starts that share an anchor: one block in
       about 77 bytes, one row of some 40 bytes. Equal strings share their anchor.
    2. Blocks are counted by anchor. An anchor met once has no repeats. Where all blocks of
       an anchor are equal, all their strings are repeated. Both need no text.
    3. Of the rest one copy of each different block is fetched. All blocks of an anchor are
       sorted together by two-stage suffix sorting, and neighbours that share ``length``
       bytes are repeated. Above ``variants`` different blocks an anchor is first dealt out by
       the bytes around it (``_sorted_runs``), so a common passage loads no single task.
    4. What was found for a block goes back to each text that holds it.
    """
    blocks = arrow_map(
        _keyed(docs).select("kid", "th", "text"), partial(_block_rows, length, gram), _BLOCKS_DDL
    )
    # Stored, so that the join below has a shuffle of its own on both sides and a very common
    # anchor's blocks can be split over several tasks.
    shared = stored(
        blocks.select("h", "d", "times")
        .groupBy("h")
        .agg(F.sum("times").alias("_n"), F.min("d").alias("_low"), F.max("d").alias("_high"))
        .filter("_n > 1")
        .select("h", (F.col("_low") == F.col("_high")).alias("alike")),
        "shared",
    )
    candidates = stored(blocks.join(shared, "h"), "candidates")
    mixed = candidates.filter("not alike")
    place = F.expr("cast(conv(hex(substring(at, 1, 4)), 16, 10) as int)")
    kinds = stored(
        mixed.groupBy("h", "d", "n").agg(
            F.sum("times").alias("times"), F.min(F.struct("kid", "th", place.alias("at"))).alias("one")
        ),
        "kinds",
    )
    wanted = kinds.select("one.kid", "one.th", F.struct("h", "d", "n", "one.at").alias("w"))
    wanted = wanted.groupBy("kid", "th").agg(F.collect_list("w").alias("wanted"))
    texts = _squeezed(docs).select("kid", "th", "z")
    # Only where a doc_id occurs twice can rows be equal; one of them stands for all.
    alone = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()
    if not alone:
        texts = texts.groupBy("kid", "th").agg(F.first("z").alias("z"))
    texts = texts.join(wanted, ["kid", "th"]).select("z", "wanted")
    cut = stored(arrow_map(texts, partial(_cut_blocks, length), _VARIANT_DDL), "blocks")
    found = _sorted_runs(cut.select("h", "d", "n", "block"), length, gram, variants)
    # A block met more than once is repeated as a whole, whatever else its anchor has.
    whole = kinds.filter("times > 1").select("h", "d", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    once = kinds.filter("times = 1").select("h", "d")
    found = stored(whole.union(found.join(once, ["h", "d"], "left_semi")), "found")
    alike = candidates.filter("alike").select(
        "kid", "th", F.struct("at", F.lit(0).alias("first"), (F.col("n") - 1).alias("last")).alias("s")
    )
    differing = mixed.join(found, ["h", "d"]).select("kid", "th", F.struct("at", "first", "last").alias("s"))
    pieces = alike.union(differing)
    if not alone:
        pieces = pieces.distinct()
    return pieces.groupBy("kid", "th").agg(F.collect_list("s").alias("spans"))


def merged_spans(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Disjoint byte ranges, in order, that the pieces cover."""
    if not spans:
        return []
    starts = [np.frombuffer(s["at"], ">i4").astype(np.int64) + s["first"] for s in spans]
    sizes = [s["last"] - s["first"] + length for s in spans]
    start = np.concatenate(starts)
    end = start + np.repeat(sizes, [len(x) for x in starts])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return list(zip(start[new].tolist(), end[np.r_[new[1:], True]].tolist()))


def without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    if not ranges:
        return data
    edges = [0, *(x for r in ranges for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
    ]
)


def _report(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = []
        for z, spans in zip(rows.column("z"), rows.column("spans")):
            data = _unpack(z.as_py())
            ranges = merged_spans(spans.as_py(), length)
            kept = without(data, ranges)
            out.append((len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), list(_RESULT)[1:])] if out else []
        if columns:
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], schema=_RESULT)


def repeat_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else,
    in the same or another text, overlaps included; matches never cross texts, and are judged
    on the input. NULL texts count as empty; texts shorter than ``length`` keep all. Rows that
    repeat count as copies of each other. Rows without doc_id are treated like others. An
    empty table gives no rows. Other columns are not read.
    """
    spans = repeated_spans(docs, length, gram)
    rows = _squeezed(docs).join(spans, ["kid", "th"], "left").select("doc_id", "z", "spans")
    return arrow_map(
        rows, partial(_report, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _strip(length: int, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        docs = rows.column("doc")
        texts, kept = docs.field(at), []
        for text, spans in zip(texts.cast(pa.binary()), rows.column("spans")):
            ranges = merged_spans(spans.as_py(), length)
            kept.append(without(text.as_py(), ranges).decode(errors="ignore") if ranges else None)
        changed = pa.array([x is not None for x in kept], pa.bool_())
        fields = [docs.field(i) for i in range(docs.type.num_fields)]
        fields[at] = pc.if_else(changed, pa.array(kept, texts.type), texts)
        new = pa.StructArray.from_arrays(fields, fields=list(docs.type))
        yield pa.RecordBatch.from_arrays([new, changed], names=["doc", "changed"])


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with repeated strings taken out of ``text``; all rows and columns stay.

    Bytes left of a character that was cut are dropped. ``n_chars``, where there is one, is counted
    anew for texts that changed. A NULL text stays NULL.
    """
    spans = repeated_spans(docs, length, gram)
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    text = F.coalesce(F.col("doc.text").cast("binary"), F.lit(b""))
    rows = rows.select(
        "doc",
        F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-1)).alias("kid"),
        F.xxhash64(text).alias("th"),
    )
    rows = rows.join(spans, ["kid", "th"], "left").select("doc", "spans")
    schema = T.StructType([rows.schema["doc"], T.StructField("changed", T.BooleanType())])
    at = [c.lower() for c in docs.columns].index("text")
    out = arrow_map(rows, partial(_strip, length, at), schema)
    columns = []
    for field in docs.schema:
        value = F.col(f"doc.`{field.name}`")
        if field.name == "n_chars":
            value = F.when(F.col("changed"), F.char_length("doc.text").cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return out.select(*columns)
