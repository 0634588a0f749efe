"""Words of many texts as 128-bit numbers, and of their windows, without a step for each word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

# Texts are taken together up to this many bytes, and at most this many words at once.
PIECE_BYTES = 2 << 20
PIECE_WORDS = 1 << 19
_SEGMENT = 4 << 20
_LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
# Factors of the two lanes: any odd numbers.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LAST = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """One number for an ordered pair."""
    x = a * FACTORS[lane]
    x += b
    x ^= x >> np.uint64(32)
    x *= _LAST[lane]
    x ^= x >> np.uint64(29)
    return x


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end; words are runs without ASCII white space."""
    starts, ends, before = [], [], True
    for at in range(0, len(data), _SEGMENT):
        space = _SPACE[data[at : at + _SEGMENT]]
        shifted = np.empty_like(space)
        shifted[0], shifted[1:] = before, space[:-1]
        starts.append(np.flatnonzero(shifted & ~space) + at)
        ends.append(np.flatnonzero(~shifted & space) + at)
        before = bool(space[-1])
    if not before:
        ends.append(np.array([len(data)]))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *ends])


def word_lanes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each word, equal where the words are.

    Eight bytes at a time are read for all words that have as many left. ``data`` ends with
    eight bytes that belong to no word.
    """
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    sizes = ends - starts
    lanes = [sizes.astype(np.uint64), sizes.astype(np.uint64)]
    left, at, chosen = sizes, starts, slice(None)
    for step in range(0, _LONG, 8):
        if step:
            chosen = np.flatnonzero((sizes > step) & (sizes <= _LONG))
            if not len(chosen):
                break
            left, at = sizes[chosen] - step, starts[chosen] + step
        part = eights[at] & _MASKS[np.minimum(left, 8)]
        for lane in (0, 1):
            lanes[lane][chosen] = mixed(lanes[lane][chosen], part, lane)
    for i in np.flatnonzero(sizes > _LONG):
        word = data[starts[i] : ends[i]]
        for lane in (0, 1):
            lanes[lane][i] = xxhash.xxh3_64_intdigest(word, seed=lane)
    return lanes[0], lanes[1]


def runs_of(words: np.ndarray, size: int, lane: int) -> np.ndarray:
    """Number of every window of ``size`` words."""
    found = words[: len(words) - size + 1]
    for i in range(1, size):
        found = mixed(found, words[i : len(words) - size + 1 + i], lane)
    return found


def doubled(runs: np.ndarray, size: int, at: np.ndarray, times: int, lane: int) -> np.ndarray:
    """Numbers of the windows of ``size * 2 ** times`` words that start at ``at``."""
    if not times:
        return runs[at]
    half = size << (times - 1)
    return mixed(doubled(runs, size, at, times - 1, lane), doubled(runs, size, at + half, times - 1, lane), lane)


def first_smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Index of the leftmost smallest value of every window of ``size`` values."""
    at = np.arange(len(values), dtype=np.int32)
    reach = 1

    def joined(left, right):
        take = left[0] <= right[0]
        return np.where(take, left[0], right[0]), np.where(take, left[1], right[1])

    while reach * 2 <= size:
        values, at = joined((values[:-reach], at[:-reach]), (values[reach:], at[reach:]))
        reach *= 2
    if size > reach:
        more = size - reach
        values, at = joined((values[:-more], at[:-more]), (values[more:], at[more:]))
    return at


class Piece:
    """Words ``lanes`` of some texts one after another; ``text`` and ``place`` of each word."""

    def __init__(self, data: bytes, starts, ends, text, place, sizes):
        self.lanes = word_lanes(data, starts, ends)
        self.text, self.place, self.sizes = text, place, sizes


def pieces(texts: Sequence[bytes], overlap: int) -> Iterator[Piece]:
    """Texts in pieces of bounded size; of a long text, neighbours share ``overlap`` words.

    ``text`` numbers the texts, ``place`` the words of each, ``sizes`` are words per text.
    """
    at = 0
    while at < len(texts):
        end, held = at + 1, len(texts[at])
        while end < len(texts) and held + len(texts[end]) <= PIECE_BYTES:
            held += len(texts[end])
            end += 1
        data = b" ".join([*texts[at:end], b"        "])
        starts, ends = word_bounds(np.frombuffer(data, np.uint8))
        edges = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
        first = np.searchsorted(starts, edges)
        sizes = np.diff(first)
        text = np.repeat(np.arange(at, end), sizes)
        place = np.arange(len(starts)) - np.repeat(first[:-1], sizes)
        whole = np.zeros(len(texts), np.int64)
        whole[at:end] = sizes
        for low in range(0, max(len(starts) - overlap, 1), PIECE_WORDS):
            cut = slice(low, low + PIECE_WORDS + overlap)
            yield Piece(data, starts[cut], ends[cut], text[cut], place[cut], whole)
        at = end
