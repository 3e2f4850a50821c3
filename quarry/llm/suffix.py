"""Suffix arrays by induced sorting, with queues that go to disk."""

from __future__ import annotations

import tempfile

import numpy as np


#: Suffixes that a queue holds in memory; a shard has more, so the rest waits on disk.
QUEUE = 200_000


class Buckets:
    """A priority queue of suffixes by first symbol, first in first out among equals.

    Induction pushes only to symbols that are still to be popped, so a bucket for
    each symbol is all the order that is needed. What exceeds the limit goes to a
    file of the task's own temporary folder.
    """

    def __init__(self, limit: int = QUEUE):
        self.limit, self.held, self.kept, self.file = limit, 0, {}, None

    def push(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        """Add suffixes in order, each to its symbol's bucket."""
        by = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[by], suffixes[by]
        cut = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]]) if len(symbols) else []
        for symbol, part in zip(symbols[cut].tolist() if len(symbols) else [], np.split(suffixes, cut[1:]) if len(symbols) else []):
            self.kept.setdefault(symbol, []).append(part)
        self.held += len(suffixes)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.kept.values():
            for i, part in enumerate(parts):
                if not isinstance(part, tuple):
                    at = self.file.seek(0, 2)
                    self.file.write(part.tobytes())
                    parts[i] = (at, len(part), part.dtype)
        self.held = 0

    def pop(self, symbol: int) -> list[np.ndarray]:
        """What has been pushed under symbol since the last pop of it, in order."""
        out = []
        for part in self.kept.pop(symbol, []):
            if isinstance(part, tuple):
                at, n, kind = part
                self.file.seek(at)
                part = np.frombuffer(self.file.read(n * kind.itemsize), dtype=kind)
            else:
                self.held -= len(part)
            out.append(part)
        return out

    def close(self) -> None:
        if self.file:
            self.file.close()


def _is_s(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last is not."""
    end = np.flatnonzero(np.r_[text[1:] != text[:-1], True])  # last places of runs
    last = end[np.cumsum(np.r_[0, text[1:] != text[:-1]])]
    after = np.minimum(last + 1, len(text) - 1)
    return (text[after] > text) & (last + 1 < len(text))


def _induce(text: np.ndarray, s: np.ndarray, seeds: np.ndarray, limit: int) -> np.ndarray:
    """All suffixes in the order that the seeds (leftmost S suffixes, sorted) induce."""
    symbols = np.unique(text).tolist()
    seed_of = Buckets(limit)
    seed_of.push(text[seeds], seeds)
    larger = Buckets(limit)  # L suffixes, smallest first
    larger.push(text[-1:], np.array([len(text) - 1], dtype=np.int32))  # nothing stands behind the last: it is L and comes first
    l_order: dict[int, np.ndarray] = {}
    for symbol in symbols:
        got = []
        while parts := larger.pop(symbol):
            wave = np.concatenate(parts)
            got.append(wave)
            before = wave[wave > 0] - 1
            before = before[~s[before]]
            larger.push(text[before], before)
        l_order[symbol] = np.concatenate(got) if got else np.zeros(0, dtype=np.int32)
        if parts := seed_of.pop(symbol):
            before = np.concatenate(parts)
            before = before[before > 0] - 1
            before = before[~s[before]]
            larger.push(text[before], before)
    smaller = Buckets(limit)  # S suffixes, largest first
    out = []
    for symbol in reversed(symbols):
        got = []
        while parts := smaller.pop(symbol):
            wave = np.concatenate(parts)
            got.append(wave)
            before = wave[wave > 0] - 1
            before = before[s[before]]
            smaller.push(text[before], before)
        l_part = l_order.pop(symbol)
        before = l_part[::-1]
        before = before[before > 0] - 1
        before = before[s[before]]
        smaller.push(text[before], before)
        out += [*got, l_part[::-1]]
    for b in (seed_of, larger, smaller):
        b.close()
    return np.concatenate(out)[::-1]


def _names(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of the strings that begin at places at, in sorted order: equal neighbours share one. Compared symbol by symbol."""
    same = size[1:] == size[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[at[1:][live] + k] == text[at[:-1][live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
        live = live[size[live] > k]
    return np.cumsum(np.r_[0, ~same])


def suffix_array(text: np.ndarray, depth: int, limit: int = QUEUE) -> np.ndarray:
    """The suffixes of text (whole numbers from 0), sorted by depth symbols at least.

    Leftmost S suffixes are sorted by what stands between them, named, and their
    names sorted in turn by doubling until depth is reached or all differ; all
    others are induced from them, in bulk for each first symbol.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    s = _is_s(text)
    lms = np.flatnonzero(s[1:] & ~s[:-1]).astype(np.int32) + 1
    if not len(lms):
        return _induce(text, s, lms, limit)
    order = _induce(text, s, lms, limit)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    by = order[is_lms[order]]  # sorted up to and with the next leftmost S suffix
    at = np.empty(n, dtype=np.int32)
    at[lms] = np.arange(len(lms), dtype=np.int32)
    k = at[by]
    rank = np.empty(len(lms), dtype=np.int64)
    rank[k] = _names(text, by, (np.diff(np.r_[lms, n - 1]) + 1)[k])
    step = 1
    while rank.max() + 1 < len(lms) and step < depth:
        second = np.r_[rank[step:] + 1, np.zeros(min(step, len(rank)), dtype=np.int64)]
        k = np.lexsort((second, rank))
        new = np.r_[True, (rank[k[1:]] != rank[k[:-1]]) | (second[k[1:]] != second[k[:-1]])]
        rank = np.empty_like(rank)
        rank[k] = np.cumsum(new) - 1
        step *= 2
    return _induce(text, s, lms[np.argsort(rank, kind="stable")], limit)
