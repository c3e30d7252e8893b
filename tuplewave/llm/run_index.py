"""A run-length index of a set of strings: run-compressed Burrows-Wheeler transform and sampled run ends.

What the index keeps has one entry for each run of the transform: its symbol, where it begins, the suffixes at both
of its ends, and the length that neighbouring suffixes of two runs have in common. The suffix order itself is dropped
when the runs are known. Anywhere else the neighbour of a suffix is the neighbour of the suffix before it moved on by
one character, so its common prefix is one shorter. Streaming the text once from sample to sample therefore gives
the matching statistics of every position against all the others; in repetitive text there are few runs.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    """``symbols`` are bytes moved up by the number of strings; each string ends with a separator of its own below them."""

    def __init__(self, strings: list[bytes]) -> None:
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begins = np.cumsum(self.lengths + 1) - self.lengths - 1
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.n = len(data)
        # Smaller than every byte and different from each other: no match crosses a separator.
        text = data.astype(np.int32) + len(strings)
        text[self.begins + self.lengths] = np.arange(len(strings))
        order = _suffix_order(text, int(self.lengths.max(initial=0)) + 1)
        before = text[order - 1]  # the transform; the first suffix has the last separator before it
        self.bounds = np.concatenate(([0], np.flatnonzero(before[1:] != before[:-1]) + 1))
        self.symbols = before[self.bounds]
        self.heads = order[self.bounds]
        self.tails = order[np.concatenate((self.bounds[1:], [self.n])) - 1]
        self.common = self._common(data, self.tails[:-1], self.heads[1:])

    @property
    def runs(self) -> int:
        return len(self.bounds)

    def _common(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of pairs of suffixes, eight bytes a step, up to the end of the shorter string."""
        ends = self.begins + self.lengths
        left = lambda x: ends[np.searchsorted(self.begins, x, side="right") - 1] - x
        most = np.minimum(left(a), left(b))
        eight = np.ndarray((len(data),), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            apart = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
            low = apart & (~apart + np.uint64(1))
            same = np.where(apart == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
            out[live] = np.minimum(out[live] + same, most[live])
            live = live[(same == 8) & (out[live] < most[live])]
        return out

    def strings(self) -> list[bytes]:
        """The strings, restored from the runs alone by stepping backwards through the transform."""
        sizes = np.diff(np.concatenate((self.bounds, [self.n])))
        whole = np.repeat(self.symbols, sizes)
        step = np.empty(self.n, np.int64)
        step[np.argsort(whole, kind="stable")] = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        at = len(self.lengths) - 1  # the suffix that is the last separator
        for i in range(self.n - 1, -1, -1):
            out[i - 1] = whole[at]
            at = step[at]
        raw = (out - len(self.lengths)).clip(0, 255).astype(np.uint8).tobytes()
        return [raw[a : a + n] for a, n in zip(self.begins.tolist(), self.lengths.tolist(), strict=True)]

    def _stream(self, where: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Ends of the matches of all positions, from those of the sampled ones."""
        ends, last = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        ends[where], last[where] = where + length, where
        return ends[np.maximum.accumulate(last)]

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest string there that also starts at another position."""
        none = np.zeros(1, np.int64)
        before = self._stream(self.heads, np.concatenate((none, self.common)))
        after = self._stream(self.tails, np.concatenate((self.common, none)))
        return np.maximum(before, after) - np.arange(self.n)

    def repeated(self, length: int) -> list[list[tuple[int, int]]]:
        """For each string the ranges [a, b) of starts whose ``length`` bytes also start elsewhere."""
        flags = np.concatenate(((self.matching_statistics() >= length).astype(np.int8), [0]))
        step = np.diff(np.concatenate(([0], flags)))
        starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        out: list[list[tuple[int, int]]] = [[] for _ in self.lengths]
        of = np.searchsorted(self.begins, starts, side="right") - 1
        for s, a, b in zip(of.tolist(), starts.tolist(), stops.tolist(), strict=True):
            out[s].append((a - int(self.begins[s]), b - int(self.begins[s])))
        return out


def _suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` symbols, by prefix doubling; only the ranks of one depth are held."""
    n, symbols = len(text), int(text.max()) + 1
    at = max(1, min(4, 62 // (symbols + 1).bit_length()))
    key = np.zeros(n, np.int64)
    for i in range(at):
        key *= symbols + 1
        key[: max(n - i, 0)] += text[i:] + 1
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if at >= depth or int(rank[order[-1]]) == n - 1:
            return order
        key = rank.astype(np.int64) * (n + 1)
        key[: max(n - at, 0)] += rank[at:].astype(np.int64) + 1
        at *= 2
