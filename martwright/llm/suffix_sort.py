"""Two-stage suffix sorting of chosen positions of a byte buffer, to a fixed depth."""

from __future__ import annotations

import numpy as np

# Ends every buffer with a suffix smaller than its successor, and lets words be read past the end.
_PAD = b"\x00\xff" + bytes(16)


class Buffer:
    """Bytes with their 8-byte big-endian words at every position."""

    def __init__(self, data: bytes, depth: int):
        self.size, self.depth = len(data), depth
        text = np.frombuffer(data + _PAD + bytes(depth), np.uint8)
        self.text = text
        self.words = np.ndarray(len(text) - 8, ">u8", text, strides=(1,)).astype(np.uint64)
        # Suffixes smaller than their successor: the first byte that differs is larger. The
        # padding's last change ends the buffer, so each run of equal bytes has an answer.
        step = np.flatnonzero(text[1:] != text[:-1])
        self.rises = np.repeat(text[step + 1] > text[step], np.diff(step, prepend=-1))

    def _offsets(self):
        """Start and mask of the words that make up ``depth`` bytes."""
        for at in range(0, self.depth, 8):
            spare = max(0, 8 - (self.depth - at))
            yield at, np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(8 * spare)

    def direct_sort(self, at: np.ndarray) -> np.ndarray:
        """Positions in the order of their first ``depth`` bytes, word by word.

        Only positions still tied with a neighbour take part in the next word.
        """
        if len(at) < 2:
            return at
        out = at.copy()
        slots = np.arange(len(at))
        group = np.zeros(len(at), np.int64)
        for offset, mask in self._offsets():
            word = self.words[out[slots] + offset] & mask
            order = np.lexsort((word, group)) if offset else np.argsort(word, kind="stable")
            out[slots] = out[slots][order]
            word, group = word[order], group[order]
            new = np.r_[True, (word[1:] != word[:-1]) | (group[1:] != group[:-1])]
            tied = ~(new & np.r_[new[1:], True])
            if not tied.any():
                break
            group = (np.cumsum(new) - 1)[tied]
            slots = slots[tied]
        return out

    def equal_neighbours(self, order: np.ndarray) -> np.ndarray:
        """Whether each position shares ``depth`` bytes with the one before or after it."""
        pairs = np.arange(len(order) - 1)
        for offset, mask in self._offsets():
            if not len(pairs):
                break
            same = (self.words[order[pairs] + offset] ^ self.words[order[pairs + 1] + offset]) & mask
            pairs = pairs[same == 0]
        out = np.zeros(len(order), bool)
        out[pairs] = True
        out[pairs + 1] = True
        return out

    def two_stage_sort(self, wanted: np.ndarray) -> np.ndarray:
        """Wanted positions (a mask) in the order of their first ``depth`` bytes.

        Suffixes smaller than their successor are sorted directly. All others follow from
        one scan over the buckets of first bytes in ascending order: when a suffix is
        passed, the suffix one byte before it takes the next place of its own bucket. For
        that each wanted stretch is followed to its next directly sorted suffix.
        """
        limit = len(self.rises)
        rises = self.rises
        mask = np.zeros(limit, bool)
        mask[: len(wanted)] = wanted
        # Follow a falling suffix to its successor until one rises.
        rising = np.flatnonzero(rises)
        ends = np.flatnonzero(mask & ~np.r_[mask[1:], True] & ~rises)
        stop = rising[np.minimum(np.searchsorted(rising, ends), len(rising) - 1)]
        grow = np.zeros(limit + 1, np.int64)
        np.add.at(grow, ends, 1)
        np.add.at(grow, stop + 1, -1)
        taken = mask | (np.cumsum(grow[:limit]) > 0)
        text = self.text
        direct = self.direct_sort(np.flatnonzero(taken & rises))
        first = text[direct]
        cuts = np.searchsorted(first, np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        done = []
        for byte in range(256):
            wave = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
            own = direct[cuts[byte] : cuts[byte + 1]]
            if not len(wave) and not len(own):
                continue
            bucket = [wave]
            while len(wave):
                before = wave[wave > 0] - 1
                wave = before[taken[before] & ~rises[before] & (text[before] == byte)]
                bucket.append(wave)
            bucket.append(own)
            sorted_here = np.concatenate(bucket)
            done.append(sorted_here)
            before = sorted_here[sorted_here > 0] - 1
            before = before[taken[before] & ~rises[before] & (text[before] > byte)]
            if len(before):
                keys = text[before]
                order = np.argsort(keys, kind="stable")
                keys, before = keys[order], before[order]
                at = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
                for lo, hi in zip(at, at[1:]):
                    waiting[keys[lo]].append(before[lo:hi])
        order = np.concatenate(done) if done else np.empty(0, np.int64)
        return order[mask[order]]
