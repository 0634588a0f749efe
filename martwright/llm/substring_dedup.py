"""Repeated word windows by level-wise doubling: what repeats at one length is looked at at twice that."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, as_bytes, batch, shuffle_width, stored
from martwright.llm.word_windows import Piece, doubled, first_smallest, pieces, runs_of

WINDOW = 20
# The first windows have a quarter of the length: two doublings lead to the whole.
_DOUBLINGS = 2
# A first window with more surroundings than this in one batch goes to the last level at once.
CROWD = 64
_FILTER_BITS = 26
_LOW = np.uint64((1 << 32) - 1)
_BLOCK, _MARK, _RANGE, _SPAN = range(4)

_ROWS = pa.schema(
    [
        ("kind", pa.int8()),
        ("a", pa.int64()),
        ("c", pa.int64()),
        ("sides", pa.int64()),
        ("did", pa.int64()),
        ("key", pa.int64()),
        ("at", pa.int64()),
        ("to", pa.int64()),
    ]
)
_ROWS_DDL = "kind tinyint, a long, c long, sides long, did long, key long, at long, to long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("did", "key", "at", "to")] + [("open", pa.bool_())])
_FOUND_DDL = "did long, key long, at long, to long, open boolean"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def document_ranks(did: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each row's document in the order of documents; equal for equal ones."""
    order = np.lexsort((key, did))
    new = np.r_[True, (did[order[1:]] != did[order[:-1]]) | (key[order[1:]] != key[order[:-1]])]
    ranks = np.empty(len(did), np.int64)
    ranks[order] = np.cumsum(new) - 1 if len(order) else 0
    return ranks


def blocks_of(piece: Piece, window: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows that share their anchor, the leftmost smallest first window.

    For each run its text, the first and last window's start, the anchor's place and number
    ``a``, a number ``c`` of all its words, and the numbers of the windows of twice the first
    length that end and start with the anchor's words (zero where the text is too short).
    """
    size, n = window >> _DOUBLINGS, len(piece.text)
    one, two = (runs_of(piece.lanes[lane], size, lane) for lane in (0, 1))
    anchors = first_smallest(one, window - size + 1)
    whole = np.flatnonzero(piece.text[: n - window + 1] == piece.text[window - 1 :])
    at = anchors[whole].astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    first, last = whole[new], whole[np.r_[new[1:], len(whole)] - 1] if len(new) else new
    at = at[new]
    ends = doubled(two, size, first, _DOUBLINGS, 1) * np.uint64(31) + doubled(two, size, last, _DOUBLINGS, 1)
    ends = ends * np.uint64(0x9E3779B97F4A7C15) + ((at - first) * window + (last - first)).astype(np.uint64)
    # Doubled windows may leave the text, or the piece; they only count where they do not.
    left = doubled(one, size, np.maximum(at - size, 0), 1, 0)
    right = doubled(one, size, np.minimum(at, len(one) - 1 - size), 1, 0)
    return dict(
        text=piece.text[first], start=piece.place[first], stop=piece.place[last], anchor=piece.place[at],
        a=one[at], c=ends ^ (ends >> np.uint64(31)), left=left, right=right,
    )


def _output(kind, a, c, sides, did, key, at, to) -> pa.RecordBatch:
    n = len(at)
    columns = [np.full(n, kind, np.int8), a, c, sides, did, key, at, to]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ROWS)], schema=_ROWS)


def _packed(start, stop, anchor):
    """Place of the anchor, and how far before it the first and last window start."""
    return anchor << 16 | (anchor - start) << 8 | (anchor - stop)


def _blocks(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First of each kind of block in a batch; the windows of all others repeat an earlier one."""
    for rows in batches:
        texts = [x.as_py() for x in rows.column("text")]
        if not texts:
            continue
        did, key = (rows.column(c).to_numpy() for c in ("did", "key"))
        ranks = document_ranks(did, key)
        found = [blocks_of(p, window) for p in pieces(texts, window - 1) if len(p.text) >= window]
        if not any(len(f["a"]) for f in found):
            continue
        b = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
        a, c = _signed(b["a"]), _signed(b["c"])
        order = np.lexsort((b["start"], ranks[b["text"]], c, a))
        b = {name: x[order] for name, x in b.items()}
        a, c, text = a[order], c[order], b["text"]
        new_a = np.r_[True, a[1:] != a[:-1]]
        first = new_a | np.r_[True, c[1:] != c[:-1]]
        of = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = (ranks[text] != ranks[text[of]]) | (b["start"] != b["start"][of])
        yield from _spans(did[text[again]], key[text[again]], b["start"][again], b["stop"][again] + window)
        group = np.cumsum(new_a[first]) - 1
        crowded = np.bincount(group)[group] > CROWD
        keep = np.flatnonzero(first)
        sides = (b["left"] & _LOW) << np.uint64(32) | b["right"] & _LOW
        some = keep[~crowded]
        at = _packed(b["start"][some], b["stop"][some], b["anchor"][some])
        yield _output(_BLOCK, a[some], c[some], _signed(sides[some]), did[text[some]], key[text[some]], at, at)
        some = keep[crowded]
        if len(some):
            yield _output(_RANGE, c[some], c[some], c[some], did[text[some]], key[text[some]], b["start"][some], b["stop"][some])
            marks = np.unique(a[some])
            yield _output(_MARK, *[marks] * 7)


def _spans(did, key, start, end) -> Iterator[pa.RecordBatch]:
    """Rows of the unions of the spans of each document."""
    if not len(start):
        return
    order = np.lexsort((start, key, did))
    did, key, start, end = (x[order] for x in (did, key, start, end))
    other = np.r_[True, (did[1:] != did[:-1]) | (key[1:] != key[:-1])]
    # Ends never fall once those of each document are moved beyond all of the one before.
    lift = (np.cumsum(other) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(np.r_[True, (start + lift)[1:] > reach[:-1]] | other)
    last = np.r_[new[1:], len(start)] - 1
    end = (reach - lift)[last]
    mix = _signed((start[new] * 1_000_003 + did[new]).astype(np.int64))
    yield _output(_SPAN, mix, mix, mix, did[new], key[new], start[new], end)


def _whole_runs(names: list[str], by: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by ``by``, cut only between different keys."""
    held = None
    for rows in batches:
        if not rows.num_rows:
            continue
        more = [rows.column(c).to_numpy() for c in names]
        held = more if held is None else [np.concatenate(x) for x in zip(held, more)]
        keys = [held[names.index(c)] for c in by]
        old = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        cut = int(old[-1]) + 1 if len(old) else 0
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None:
        yield held


def narrowed(run: np.ndarray, sides: np.ndarray, least: np.ndarray, most: np.ndarray, window: int):
    """Offsets (how far windows start before the anchor) that the doubled windows leave open.

    A window that starts a quarter or more before the anchor holds the doubled window to the
    anchor's left; one that goes on as far behind it holds the one to its right. Where the
    doubled window does not repeat among the blocks of the same anchor, none of these can.
    """
    quarter = window >> _DOUBLINGS

    def repeated(side: np.ndarray) -> np.ndarray:
        _, at, counts = np.unique(run.astype(np.uint64) << np.uint64(32) | side, return_inverse=True, return_counts=True)
        return counts[at] > 1

    left = repeated(sides >> np.uint64(32))
    right = repeated(sides & _LOW)
    most = np.where(left, most, np.minimum(most, quarter - 1))
    least = np.where(right, least, np.maximum(least, window - 2 * quarter + 1))
    return least, most


def _settle_blocks(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows still open, and spans known to repeat, of rows sorted by anchor."""
    names = _ROWS.names
    for kind, a, c, sides, did, key, at, to in _whole_runs(names, ["a"], batches):
        ready = kind >= _RANGE
        if ready.any():
            yield batch(_FOUND, did=did[ready], key=key[ready], at=at[ready], to=to[ready], open=kind[ready] == _RANGE)
        marked = np.unique(a[kind == _MARK])
        rows = kind == _BLOCK
        if not rows.any():
            continue
        a, c, sides, did, key, at = (x[rows] for x in (a, c, sides, did, key, at))
        place, most, least = at >> 16, at >> 8 & 255, at & 255
        new_a = np.r_[True, a[1:] != a[:-1]]
        first = new_a | np.r_[True, c[1:] != c[:-1]]
        of = np.flatnonzero(first)[np.cumsum(first) - 1]
        again = (did != did[of]) | (key != key[of]) | (at != at[of])
        if again.any():
            found = [x[again] for x in (did, key, place - most, place - least + window)]
            yield batch(_FOUND, **dict(zip(("did", "key", "at", "to"), found)), open=np.zeros(len(found[0]), bool))
        group = np.cumsum(new_a[first]) - 1
        crowd = np.isin(a[first], marked)
        several = (np.bincount(group)[group] > 1) | crowd
        some = np.flatnonzero(first)[several]
        if not len(some):
            continue
        low, high = narrowed(group[several], sides[some].view(np.uint64), least[some], most[some], window)
        crowd = crowd[several]
        low, high = np.where(crowd, least[some], low), np.where(crowd, most[some], high)
        left = low <= high
        some, low, high = some[left], low[left], high[left]
        yield batch(
            _FOUND, did=did[some], key=key[some], at=place[some] - high, to=place[some] - low, open=np.ones(len(some), bool)
        )


_WINDOWS = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "did", "key", "at", "to")])
_WINDOWS_DDL = "w1 long, w2 long, did long, key long, at long, to long"


def _windows(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open windows of each document, first of each kind in a batch; ``to`` marks spans."""
    unpack = zstandard.ZstdDecompressor().decompress
    size = window >> _DOUBLINGS
    for rows in batches:
        texts = [unpack(x.as_py()) for x in rows.column("z")]
        if not texts:
            continue
        did, key = (rows.column(c).to_numpy() for c in ("did", "key"))
        ranks = document_ranks(did, key)
        lists = rows.column("open")
        ranges, lengths = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        many = (ranges & 255) + 1
        starts = np.repeat((ranges >> 8) - np.cumsum(many) + many, many) + np.arange(many.sum())
        text = np.repeat(np.repeat(np.arange(len(texts)), lengths), many)
        # Ranges of one anchor may meet those of a piece's edge.
        both = np.unique(text << 40 | starts)
        text, starts = both >> 40, both & (1 << 40) - 1
        out = []
        for piece in pieces(texts, window - 1):
            if len(piece.text) < window:
                continue
            # Where the first word of each text is, or would be, in this piece.
            edge = np.flatnonzero(np.r_[True, piece.text[1:] != piece.text[:-1]])
            offset = np.zeros(len(texts), np.int64)
            offset[piece.text[edge]] = edge - piece.place[edge]
            here = slice(np.searchsorted(text, piece.text[0]), np.searchsorted(text, piece.text[-1], "right"))
            at = starts[here] + offset[text[here]]
            fits = (at >= 0) & (at + window <= len(piece.text))
            lanes = [doubled(runs_of(piece.lanes[i], size, i), size, at[fits], _DOUBLINGS, i) for i in (0, 1)]
            out.append((_signed(lanes[0]), _signed(lanes[1]), text[here][fits], starts[here][fits]))
        if not out:
            continue
        w1, w2, text, starts = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((starts, ranks[text], w2, w1))
        w1, w2, text, starts = (x[order] for x in (w1, w2, text, starts))
        if not len(w1):
            continue
        new = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        of = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (ranks[text] != ranks[text[of]]) | (starts != starts[of])
        for spans in _spans(did[text[again]], key[text[again]], starts[again], starts[again] + window):
            mix = spans.column("a")
            yield batch(_WINDOWS, w1=mix, w2=mix, **{c: spans.column(c) for c in ("did", "key", "at", "to")})
        text, starts = text[new], starts[new]
        yield batch(_WINDOWS, w1=w1[new], w2=w2[new], did=did[text], key=key[text], at=starts, to=np.full(len(text), -1))


def _settle_windows(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of all but the first window of each kind; rows come sorted by kind and place."""
    for w1, w2, did, key, at, to in _whole_runs(_WINDOWS.names, ["w1", "w2"], batches):
        ready = to >= 0
        out = [x[ready] for x in (did, key, at, to)]
        w1, w2, did, key, at = (x[~ready] for x in (w1, w2, did, key, at))
        new = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])] if len(w1) else np.zeros(0, bool)
        of = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (did != did[of]) | (key != key[of]) | (at != at[of])
        out = [np.concatenate(x) for x in zip(out, [x[again] for x in (did, key, at, at + window)])]
        yield batch(_FOUND, **dict(zip(("did", "key", "at", "to"), out)), open=np.zeros(len(out[0]), bool))


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``did, key, text``, and whether no doc_id occurs twice.

    Rows equal in ``did`` and ``key`` are the same document twice. ``did`` is doc_id, NULL as the
    smallest number. Where a doc_id occurs more than once,
    ``key`` is a hash of the text; otherwise it is zero, and shuffles carry nothing for it.
    """
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did")
    alone = docs.groupBy(did).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    rows = docs.select(did, as_bytes())
    return rows.select("did", (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("key"), "text"), alone


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for rows in batches:
        packed = pa.array([packer.compress(x.as_py()) for x in rows.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([rows.column("did"), rows.column("key"), packed], names=["did", "key", "z"])


def _maybe(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose did may be in ``ids``, and rows where it is not, by a bitmap of 2^26 bits at most.

    Other rows than the wanted ones pass the first more often as the ids grow; a join follows.
    """
    slot = F.pmod(F.xxhash64("did"), F.lit(1 << _FILTER_BITS))
    part, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    bits = ids.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    marked = rows.withColumn("part", part).join(F.broadcast(bits), "part", "left")
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = marked.select(
        *rows.columns, F.coalesce(byte, F.lit(0)).alias("_byte"), (bit % 8).cast("int").alias("_shift")
    )
    hit = F.expr("(shiftright(_byte, _shift) & 1) = 1")
    return marked.filter(hit).select(*rows.columns), marked.filter(~hit).select(*rows.columns)


def _with(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Documents, compressed for the shuffle, with their list."""
    packed = arrow_map(docs, _squeeze, "did long, key long, z binary")
    same = (packed["did"] == lists["_did"]) & (packed["key"] == lists["_key"])
    return packed.join(lists.hint("merge"), same, how).drop("_did", "_key")


def _listed(found: DataFrame, value: Column, name: str) -> DataFrame:
    by = found.groupBy(F.col("did").alias("_did"), F.col("key").alias("_key"))
    return by.agg(F.collect_set(value).alias(name))


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans ``did, key, at, to`` of words in windows whose words also start earlier.

    First, every window of a quarter of the length that is the smallest of its neighbours (each
    whole window holds one) is compared, together with the block of windows around it. Equal
    blocks are settled by their first. Where one first window occurs in different blocks, windows
    of twice its length on its left and right are compared; where these repeat, the whole
    windows that hold them. Every level looks only at what repeated on the one before; after
    the whole length nothing is left, as longer windows consist of these.

    What repeats inside a batch is settled there, so a window occurs once per batch in a
    shuffle, however often it is in the texts, and no group is large. Windows are compared by
    128 bits. ``window`` is a multiple of four below 256.
    """
    if window % 4 or not 4 <= window < 256:
        raise ValueError("window must be a multiple of four below 256")
    width = shuffle_width(rows.sparkSession)
    blocks = arrow_map(rows, partial(_blocks, window), _ROWS_DDL)
    dealt = blocks.repartition(width, "a").sortWithinPartitions("a", "c", "did", "key", "at")
    found = stored(arrow_map(dealt, partial(_settle_blocks, window), _FOUND_DDL), "blocks")
    ranges = found.filter("open")
    lists = _listed(ranges, F.shiftleft("at", 8).bitwiseOR(F.col("to") - F.col("at")), "open")
    near, _ = _maybe(rows, ranges.select("did"))
    windows = arrow_map(_with(near, lists, "inner"), partial(_windows, window), _WINDOWS_DDL)
    dealt = windows.repartition(width, "w1").sortWithinPartitions("w1", "w2", "did", "key", "at")
    more = stored(arrow_map(dealt, partial(_settle_windows, window), _FOUND_DDL), "windows")
    return found.filter("not open").unionByName(more).drop("open")


def kept_words(words: list[bytes], spans: np.ndarray) -> list[bytes]:
    """Words outside the spans, each given as ``at << 31 | length``."""
    if not len(spans):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    at = spans >> 31
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (spans & (1 << 31) - 1), -1)
    return list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


_REPORT = pa.schema(
    [("did", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_kept", pa.int64()), ("text", pa.binary())]
)
_REPORT_DDL = "did long, key long, n_words long, n_kept long, text binary"


def _apply(hashed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    none = np.zeros(0, np.int64)
    for rows in batches:
        out = []
        whole = "text" in rows.schema.names
        spans = rows.column("spans") if not whole else None
        for i, data in enumerate(rows.column("text" if whole else "z")):
            words = (data.as_py() if whole else unpack(data.as_py())).split()
            here = spans[i].values if spans is not None else None
            kept = kept_words(words, none if here is None else here.to_numpy())
            text = b" ".join(kept)
            out.append((len(words), len(kept), hashlib.sha256(text).digest() if hashed else text))
        if out:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), list(_REPORT)[2:])]
            yield pa.RecordBatch.from_arrays([rows.column("did"), rows.column("key"), *columns], schema=_REPORT)


def _reported(docs: DataFrame, window: int, hashed: bool) -> DataFrame:
    """One row for each row of ``docs``: key, words, words kept, and the kept text or its hash.

    Of equal rows the first is treated as any document; all windows of the others also start in
    it, so they lose every word if they have a whole window.
    """
    rows, alone = keyed(docs)
    spans = repeated_spans(rows, window)
    near, rest = _maybe(rows, spans.select("did"))
    lists = _listed(spans, F.shiftleft("at", 31).bitwiseOR(F.col("to") - F.col("at")), "spans")
    found = arrow_map(_with(near, lists, "left"), partial(_apply, hashed), _REPORT_DDL)
    found = found.unionByName(arrow_map(rest, partial(_apply, hashed), _REPORT_DDL))
    if alone:
        return found
    first = found.groupBy("did", "key").agg(
        *(F.first(c).alias(c) for c in ("n_words", "n_kept", "text")), F.count(F.lit(1)).alias("_n")
    )
    copies = first.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    gone = (F.col("_copy") > 1) & (F.col("n_words") >= window)
    nothing = F.lit(hashlib.sha256(b"").digest() if hashed else b"")
    return copies.select(
        "did", "key", "n_words",
        F.when(gone, F.lit(0).cast("long")).otherwise(F.col("n_kept")).alias("n_kept"),
        F.when(gone, nothing).otherwise(F.col("text")).alias("text"),
    )


def _result(found: DataFrame, *more: Column) -> DataFrame:
    doc_id = F.when(F.col("did") != F.lit(-(1 << 63)), F.col("did")).alias("doc_id")
    return found.select(doc_id, "n_words", (F.col("n_words") - F.col("n_kept")).alias("n_removed"), *more)


def repeat_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs(doc_id, text)``.

    Removed is each word in a window of ``window`` words that also starts earlier: in a document
    with a smaller doc_id, or further up in the same one. Windows are judged on the input. Words
    are runs without ASCII white space, unchanged; kept words are joined by a space for the hash.
    NULL and empty texts have no words. A NULL doc_id comes first; rows that share a doc_id are
    ordered by a hash of their text, and of equal rows one comes first. Other columns are not
    read. An empty table gives no rows.
    """
    return _result(_reported(docs, window, True), F.lower(F.hex("text")).alias("kept_sha256"))


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: what is left of every row, words joined by a space.

    Rows and words are treated as ``repeat_report`` does.
    """
    return _result(_reported(docs, window, False), F.col("text").cast("string").alias("text"))
