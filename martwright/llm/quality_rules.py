"""Quality rules: plain counts, and a hashed n-gram likelihood ratio to a trusted target."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, as_bytes, shuffle_width, stored

# Buckets (a power of two), pseudo-count of a ratio of one, and the share of the trusted texts,
# each scored without itself, that the threshold may reject.
BITS = 22
PRIOR = 2.0
REJECTED_SHARE = 0.01
# Thresholds are multiples of one over this.
_STEPS = 1000
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_NOT_COUNTED = _SPACES + bytes(range(0x80, 0xC0))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 150_000
_FILTER_BITS = 26
# Counts travel in blocks of this many buckets.
_BLOCK = 1 << 14


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))


def gram_buckets(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bucket of every one- and two-word gram."""
    two = hashes[:-1] * np.uint64(31) + hashes[1:]
    return (np.concatenate([hashes * _MIX, two * _MIX]) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_words(words: list[bytes], hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that the text holds twice or more, first ones included."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    mixed = np.zeros(count, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x100000001B3) + hashes[i : i + count]
    if len(np.unique(mixed)) == count:
        return 0
    # Some may be equal: compare the words themselves, by the first window like each.
    first: dict[tuple, int] = {}
    twice = np.zeros(count + window, np.int64)
    marked = np.zeros(count, bool)
    for i in range(count):
        start = first.setdefault(tuple(words[i : i + window]), i)
        if start != i:
            marked[start] = marked[i] = True
    at = np.flatnonzero(marked)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + window, -1)
    return int(np.count_nonzero(np.cumsum(twice)[: len(words)]))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


_COUNTS = pa.schema([("block", pa.int32()), ("counts", pa.binary())])


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())), 1)


def _unpacked(data: bytes) -> np.ndarray:
    """Target and raw counts of a block; the length tells the integers' size."""
    plain = zlib.decompress(data)
    return np.frombuffer(plain, f"u{len(plain) // (2 * _BLOCK)}").reshape(2, _BLOCK)


def _count(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task: one compressed row for each block of buckets at most."""
    counts = np.zeros((2, 1 << bits), np.int64)
    for rows in batches:
        found: list[list[np.ndarray]] = [[], []]
        held = 0
        for text, target in zip(rows.column("text"), rows.column("target").to_pylist()):
            buckets = gram_buckets(word_hashes(text.as_py().split()), bits)
            found[not target].append(buckets)
            held += len(buckets)
            if held > 1 << 20:
                _add(counts, found)
                found, held = [[], []], 0
        _add(counts, found)
    for block in range((1 << bits) // _BLOCK):
        part = counts[:, block * _BLOCK : (block + 1) * _BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(part)])], schema=_COUNTS)


def _add(counts: np.ndarray, found: list[list[np.ndarray]]) -> None:
    for side, parts in enumerate(found):
        if parts:
            counts[side] += np.bincount(np.concatenate(parts), minlength=counts.shape[1])


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks dealt to a task."""
    sums: dict[int, np.ndarray] = {}
    for rows in batches:
        for block, data in zip(rows.column("block").to_pylist(), rows.column("counts")):
            if block not in sums:
                sums[block] = np.zeros((2, _BLOCK), np.int64)
            sums[block] += _unpacked(data.as_py()).astype(np.int64)
    for block, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(total)])], schema=_COUNTS)


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in ``ids`` (no id twice), few others' texts being moved to find out.

    A bitmap of hashed ids, 2^26 bits at most, is broadcast and passes every wanted row; the exact
    join follows. The join is the same at every size.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _FILTER_BITS))
    part, bit = F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot)
    bits = ids.groupBy(part).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    wanted = F.expr("shiftright(byte, shift) & 1") == 1
    near = (
        rows.withColumn("part", part)
        .join(F.broadcast(bits), "part")
        .select("doc_id", "text", byte.alias("byte"), (bit % 8).cast("int").alias("shift"))
        .filter(wanted)
        .select("doc_id", "text")
    )
    # Ids occur once. A semi join would be moved below the filter.
    return near.join(ids.hint("merge"), "doc_id")


def bucket_counts(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> np.ndarray:
    """Grams of each bucket: in trusted texts, and in all texts.

    The raw counts cover every document, the target counts every trusted one. Raw texts are counted
    where they are read; trusted texts are shuffled once. A task reports its counts as compressed
    blocks, which are summed in Spark: two counts for each bucket are all that reaches the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long"), as_bytes())
    both = rows.select("text", F.lit(False).alias("target")).unionByName(
        _only(rows, _ids(trusted)).select("text", F.lit(True).alias("target"))
    )
    schema = "block int, counts binary"
    counted = arrow_map(both, partial(_count, bits), schema)
    dealt = counted.repartition(shuffle_width(docs.sparkSession), "block")
    counts = np.zeros((2, 1 << bits), np.int64)
    for row in arrow_map(dealt, _sum_blocks, schema).collect():
        counts[:, row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = _unpacked(bytes(row["counts"]))
    return counts


def _ids(trusted: DataFrame) -> DataFrame:
    return trusted.select(F.col("doc_id").cast("long")).dropna().distinct()


def held_out_means(buckets: np.ndarray, counts: np.ndarray, totals: tuple[int, int]) -> tuple[float, float]:
    """Mean log ratio of a text's grams, had it been trusted or not, without its own counts.

    A gram's ratio is its target count over the count that its raw share leads to expect, both
    raised by ``PRIOR``: what the other texts do not have has ratio one.
    """
    if not len(buckets):
        return 0.0, 0.0
    at, own = np.unique(buckets, return_counts=True)
    size = len(buckets)
    target, raw = counts[0, at], counts[1, at] - own
    rest = max(totals[1] - size, 1)

    def mean(seen: np.ndarray, total: int) -> float:
        ratio = np.log((seen + PRIOR) / (raw * (total / rest) + PRIOR))
        return float((ratio * own).sum() / size)

    # An untrusted text may count fewer in the target than it has; its first mean is not used.
    return mean(np.maximum(target - own, 0), max(totals[0] - size, 0)), mean(target, totals[0])


_VERDICTS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("mean_ratio", pa.float64())]
)
_VERDICTS_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, mean_ratio double"
)


def measures(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple:
    """Plain counts of a text, and whether it fails by them."""
    repeats = repeated_words(words, hashes)
    failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        repeated_lines(text),
        repeats,
        failed,
    )


_MEANS = pa.schema([*list(_VERDICTS)[:7], ("as_trusted", pa.float64()), ("as_other", pa.float64())])
_MEANS_DDL = _VERDICTS_DDL.split(", kept")[0] + ", as_trusted double, as_other double"


def _measure(model: Broadcast, totals: tuple, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = []
        for text in rows.column("text"):
            data = text.as_py()
            words = data.split()
            hashes = word_hashes(words)
            means = held_out_means(gram_buckets(hashes, bits), model.value, totals)
            found.append((*measures(data, words, hashes), *means))
        if found:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found), list(_MEANS)[1:])]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], schema=_MEANS)


def lowest_kept(means: DataFrame, rejected_share: float) -> float:
    """Largest threshold, in steps of 1/1000, that rejects at most this share of ``mean_ratio``."""
    step = F.floor(F.col("mean_ratio") * _STEPS).alias("step")
    steps = sorted(tuple(r) for r in means.groupBy(step).agg(F.count(F.lit(1))).collect())
    allowed, below = rejected_share * sum(n for _, n in steps), 0
    for at, n in steps:
        below += n
        if below > allowed:
            return at / _STEPS
    return -math.inf


def held_out_verdicts(
    docs: DataFrame, trusted: DataFrame, rejected_share: float = REJECTED_SHARE, bits: int = BITS
) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``mean_ratio`` of every row of ``docs``.

    ``trusted(doc_id)`` names target documents. A text is kept if the base rules hold and the
    mean log-likelihood ratio of its one- and two-word grams, target over raw corpus, reaches a
    threshold. Every text is scored by the other texts alone: its own grams are taken out of the
    raw counts and, if it is trusted, out of the target. The threshold lets at most
    ``rejected_share`` of the trusted texts that hold the base rules fall below it.

    NULL and empty texts have no words and fail. Words are case-sensitive. Without trusted rows
    every ratio is zero, so only the base rules decide. Repeated rows are judged alike; rows
    without doc_id are judged but never trusted; an empty table gives no rows. Other columns are
    not read.
    """
    counts = bucket_counts(docs, trusted, bits)
    totals = tuple(counts.sum(axis=1).tolist())
    model = docs.sparkSession.sparkContext.broadcast(counts)
    rows = docs.select(F.col("doc_id").cast("long"), as_bytes())
    # Texts are not moved to learn which are trusted: both means are stored, and one is picked.
    means = stored(arrow_map(rows, partial(_measure, model, totals, bits), _MEANS_DDL), "means")
    marked = means.join(_ids(trusted).withColumn("trusted", F.lit(True)), "doc_id", "left")
    mean = F.when(F.col("trusted"), F.col("as_trusted")).otherwise(F.col("as_other"))
    marked = marked.withColumn("mean_ratio", mean)
    threshold = lowest_kept(marked.filter("trusted and not base_failed"), rejected_share)
    kept = ~F.col("base_failed") & (F.col("mean_ratio") >= F.lit(threshold))
    return marked.withColumn("kept", kept).select(*_VERDICTS.names)
