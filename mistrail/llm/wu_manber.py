"""Wu-Manber search for many patterns in one text of bytes, many stretches of it at a time."""

from __future__ import annotations

import numpy as np

#: Letters of a block, and bits of the hash that indexes the shift table.
BLOCK = 10
BITS = 20
#: Length of the stretches of text that are scanned side by side.
STRETCH = 2048
#: Letters that are scanned at a time.
SLICE = 4_000_000


class WuManber:
    """Tables for ``patterns`` (bytes, none shorter than ``least``), as of Wu and Manber.

    ``least`` letters of each pattern, its window, make the tables: the shift table tells for each block how far the
    window can move on, 0 where the block ends the window of a pattern. There the hash of the whole window selects the
    patterns of its bucket, and a direct comparison confirms one.
    """

    def __init__(self, patterns: list[bytes], least: int, block: int = BLOCK):
        if any(len(p) < least for p in patterns) or least < max(block, 8):
            raise ValueError("a pattern is shorter than the window, or the window than a block or 8 letters")
        self.least, self.block, self.patterns = least, block, patterns
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        longest = int(self.lengths.max(initial=least))
        self.letters = np.zeros((len(patterns), longest), np.uint8)
        for i, p in enumerate(patterns):
            self.letters[i, : len(p)] = np.frombuffer(p, np.uint8)
        self.shift = np.full(1 << BITS, least - block + 1, np.uint8)
        for end in range(block, least + 1):
            blocks = self._hash(self.letters, np.arange(len(patterns)), np.full(len(patterns), end)) if patterns else np.zeros(0, int)
            np.minimum.at(self.shift, blocks, np.uint8(least - end))
        rows = np.ascontiguousarray(self.letters[:, :least])
        windows = self._window_hash(rows.ravel(), np.arange(len(patterns)) * least) if patterns else np.zeros(0, np.uint64)
        self.order = np.argsort(windows, kind="stable")
        self.buckets, first = np.unique(windows[self.order], return_index=True)
        self.first = np.append(first, len(patterns))

    def _hash(self, letters: np.ndarray, row: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = np.zeros(len(row), np.uint32)
        for i in range(self.block):
            h = h * np.uint32(37) + letters[row, end - self.block + i]
        return (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)

    def _window_hash(self, text: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hash of the window at each start, eight letters at a time; the last eight may overlap those before."""
        words = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
        h = np.zeros(len(start), np.uint64)
        for at in [*range(0, self.least - 8, 8), self.least - 8]:
            h = (h ^ words[start + at]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern number) of every occurrence in ``text``, an array of bytes of any length."""
        parts = []
        for begin in range(0, max(1, len(text)), SLICE):
            at, number = self._find(np.ascontiguousarray(text[begin : begin + SLICE + self.letters.shape[1]]))
            own = at < SLICE
            parts.append((at[own] + begin, number[own]))
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])

    def _find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < self.least or not self.patterns:
            return nothing
        # blocks[e]: table index of the block that ends just before position e.
        h = np.zeros(n - self.block + 1, np.uint32)
        for i in range(self.block):
            h *= np.uint32(37)
            h += text[i : n - self.block + 1 + i]
        h *= np.uint32(2654435761)
        h >>= np.uint32(32 - BITS)
        at = np.arange(self.least, n + 1, STRETCH, dtype=np.int64)
        end = np.minimum(at + STRETCH, n + 1)
        found = []
        while len(at):
            step = self.shift[h[at - self.block]]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            going = at < end
            if not going.all():
                at, end = at[going], end[going]
        if not found:
            return nothing
        start = np.concatenate(found) - self.least
        positions, numbers = [], []
        for i in range(0, len(start), 1 << 18):
            s = start[i : i + (1 << 18)]
            window = self._window_hash(text, s)
            bucket = np.searchsorted(self.buckets, window)
            ok = bucket < len(self.buckets)
            ok[ok] = self.buckets[bucket[ok]] == window[ok]
            s, bucket = s[ok], bucket[ok]
            size = self.first[bucket + 1] - self.first[bucket]
            s = np.repeat(s, size)
            nth = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
            number = self.order[np.repeat(self.first[bucket], size) + nth]
            fits = s + self.lengths[number] <= n
            s, number = s[fits], number[fits]
            same = np.ones(len(s), bool)
            for k in range(self.letters.shape[1]):
                live = np.flatnonzero(same & (k < self.lengths[number]))
                if not len(live):
                    break
                same[live] = text[s[live] + k] == self.letters[number[live], k]
            positions.append(s[same])
            numbers.append(number[same])
        return np.concatenate(positions), np.concatenate(numbers)
