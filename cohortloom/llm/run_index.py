"""A run-length index of byte strings: run-compressed Burrows-Wheeler transforms, and matching statistics streamed against them.

Many strings of many blocks stand in one transform; a block's bytes are symbols of their own, so that a pattern
only meets strings of its own block.
"""

from __future__ import annotations

import numpy as np


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one little-endian number; ``data`` is followed by zeros."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded, "<u8", (len(padded) - k) // 8, k)
        own = out[k::8]
        own[:] = part[: len(own)]
    return out[: len(data) + 1]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings with eight zeros behind each, and where each begins."""
    length = np.diff(offsets)
    start = offsets[:-1] + 8 * np.arange(len(length))
    out = np.zeros(len(data) + 8 * len(length) + 8, np.uint8)
    out[np.arange(len(data)) + np.repeat(start - offsets[:-1], length)] = data
    return out, start


def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of what ``order`` sorts by ``keys``; equal ones share a rank."""
    new = np.zeros(len(order), bool)
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


class RunLengthIndex:
    """Of strings in blocks: the runs of the transform, their symbols, and where the suffixes at both ends of a run stand.

    ``block`` numbers are from 0 and ascend with the strings. The suffixes themselves are not kept.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: np.ndarray):
        length = np.diff(offsets)
        self.text, start = spaced(data, offsets)
        self.words = words(self.text)
        n_blocks = int(block[-1]) + 1
        # every position of a string, and the one behind it
        own = np.repeat(np.arange(len(length)), length + 1)
        at = np.arange(len(own)) - np.repeat(np.cumsum(length + 1) - (length + 1), length + 1)
        place, left = start[own] + at, length[own] - at
        self.left = np.zeros(len(self.text) + 1, np.int32)
        self.left[place] = left
        big = self.words[place].byteswap()
        blocks = block[own].astype(np.int64)
        short = np.minimum(left, 8)
        order = np.lexsort((short, big, blocks))
        rank, depth, n = _ranks(order, short, big, blocks), 8, len(own)
        while depth < int(length.max(initial=0)) + 1 and int(rank.max()) < n:
            further = np.where(left > depth, rank[np.minimum(np.arange(n) + depth, n - 1)], 0)
            both = rank * (n + 1) + further
            rank = _ranks(np.argsort(both), both)
            depth *= 2
        order = np.argsort(rank * (n + 1) + np.arange(n))  # equal suffixes in the order of their strings
        first = blocks * 257 + np.where(left > 0, self.text[place].astype(np.int64) + 1, 0)
        before = blocks * 257 + np.where(at > 0, self.text[np.maximum(place - 1, 0)].astype(np.int64) + 1, 0)
        first, before, place = first[order], before[order], place[order]
        self.start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        ends = np.concatenate([self.start[1:], [n]])
        self.symbol = before[self.start]
        self.sample_first, self.sample_last = place[self.start], place[ends - 1]
        self.end = ends - 1
        self.by = np.argsort(self.symbol, kind="stable")
        sorted_symbol, size = self.symbol[self.by], (ends - self.start)[self.by]
        new = np.concatenate([[True], sorted_symbol[1:] != sorted_symbol[:-1]])
        total = np.cumsum(size) - size
        within = total - np.repeat(total[new], np.diff(np.concatenate([np.flatnonzero(new), [len(new)]])))
        self.to = np.empty(len(self.by), np.int64)
        self.to[self.by] = np.searchsorted(first, sorted_symbol) + within
        self.sorted_symbol = sorted_symbol
        self.runs = len(self.start)
        self.keys = sorted_symbol * (self.runs + 1) + self.by
        self.block_row = np.searchsorted(first, np.arange(n_blocks) * 257)

    def _common(self, at: np.ndarray, pattern: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes agree from ``at`` in the text and from ``place`` in the pattern, ``most`` at most."""
        most = np.minimum(most, self.left[at])
        same = np.zeros(len(at), np.int64)
        open_ = np.flatnonzero(most > 0)
        done = 0
        while len(open_):
            differ = self.words[at[open_] + done] ^ pattern[place[open_] + done]
            equal = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            same[open_] += equal
            done += 8
            open_ = open_[(equal == 8) & (most[open_] > done)]
        return np.minimum(same, most)

    def statistics(self, data: np.ndarray, offsets: np.ndarray, block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``width`` bytes from a position of a pattern on occur in a string of its block: pattern numbers and positions.

        All patterns are read from their ends at once. A pattern keeps a row whose suffix agrees with what was
        read on the greatest length. If the row's run has the byte before it, the row moves on; else the ends of the nearest
        runs of that byte, above and below, tell by their sampled suffixes which agrees on more.
        """
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        text, start = spaced(data, offsets)
        pattern = words(text)
        length, start, block = length[order], start[order], block[order].astype(np.int64)
        row, agreed = self.block_row[block], np.zeros(len(order), np.int64)
        active = len(order)
        found, places = [], []
        for step in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length[:active], -step, "left"))
            at = start[:active] + length[:active] - 1 - step
            wanted = block[:active] * 257 + text[at] + 1
            r = row[:active]
            run = np.searchsorted(self.start, r, "right") - 1
            next_row = self.to[run] + r - self.start[run]
            next_agreed = agreed[:active] + 1
            jump = np.flatnonzero(self.symbol[run] != wanted)
            if len(jump):
                w = wanted[jump]
                j = np.searchsorted(self.keys, w * (self.runs + 1) + run[jump])
                low, high = np.maximum(j - 1, 0), np.minimum(j, self.runs - 1)
                has_low = (j > 0) & (self.sorted_symbol[low] == w)
                has_high = (j < self.runs) & (self.sorted_symbol[high] == w)
                up, down = self.by[low], self.by[high]
                old = agreed[jump]
                with_up = np.where(has_low, self._common(self.sample_last[up], pattern, at[jump] + 1, np.where(has_low, old, 0)), -1)
                with_down = np.where(has_high, self._common(self.sample_first[down], pattern, at[jump] + 1, np.where(has_high, old, 0)), -1)
                above = with_up >= with_down
                none = ~has_low & ~has_high
                to_row = np.where(above, self.to[up] + self.end[up] - self.start[up], self.to[down])
                next_row[jump] = np.where(none, self.block_row[block[jump]], to_row)
                next_agreed[jump] = np.where(none, 0, np.maximum(with_up, with_down) + 1)
            row[:active], agreed[:active] = next_row, np.minimum(next_agreed, width)
            hit = np.flatnonzero(agreed[:active] == width)
            if len(hit):
                found.append(order[hit])
                places.append(length[hit] - 1 - step)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(places)
