"""A run-length index of a bounded text: run-compressed BWT with sampled run ends, and its matches.

The text is a sequence of byte strings, each followed by a separator that occurs once, so no match
crosses strings.  What is kept of the Burrows-Wheeler transform is one entry a run: its symbol, its
first row, the text positions of its first and last row, and how much its head has in common with the
tail of the run before.  In repetitive text there are far fewer runs than bytes.

Between two sampled positions the longest match of a position is that of its predecessor less one, so
the samples determine all matching statistics, and one pass over the samples in text order streams
them as intervals.  The suffix array that the runs are read from exists only while an index is built;
callers bound the text of one index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_CHUNK = 7  # nine-bit symbols in a 63-bit word


def _symbols(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all strings, and the start of each; a separator is 256 and three digits of its number."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 4)[:-1]])
    out = np.zeros(int(lengths.sum() + 4 * len(strings)) + 2 * _CHUNK, dtype=np.uint64)
    flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    out[np.arange(len(flat)) + 4 * np.repeat(np.arange(len(strings)), lengths)] = flat
    ends, number = starts + lengths, np.arange(len(strings), dtype=np.uint64)
    out[ends] = 256
    for digit in range(3):
        out[ends + 1 + digit] = (number >> np.uint64(8 * digit)) & np.uint64(255)
    return out, starts


def _words(symbols: np.ndarray, size: int) -> np.ndarray:
    """The next seven symbols of each position as one integer."""
    words = np.zeros(size, dtype=np.uint64)
    for i in range(_CHUNK):
        words = (words << np.uint64(9)) | symbols[i : i + size]
    return words


def _suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols or more, by doubling of sorted prefixes."""
    size = len(words)
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(size + 1, dtype=np.int64)
    rank[size] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(size), 0))
    length = _CHUNK
    while length < depth:
        alone = new & np.append(new[1:], True)
        places = np.flatnonzero(~alone)  # positions of the order that are still tied
        if not len(places):
            break
        tied = order[places]
        second = rank[np.minimum(tied + length, size)]
        key = (rank[tied].astype(np.uint64) << np.uint64(32)) | (second + 1).astype(np.uint64)
        sort = np.argsort(key, kind="stable")
        tied, key = tied[sort], key[sort]
        order[places] = tied
        changed = np.concatenate([[True], key[1:] != key[:-1]])
        new[places] = changed
        rank[tied] = places[np.maximum.accumulate(np.where(changed, np.arange(len(places)), 0))]
        length *= 2
    return order


def _common(words: np.ndarray, symbols: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, found by words and then symbols."""
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    for start in range(0, depth, _CHUNK):
        at, bt = a[live] + start, b[live] + start
        inside = (at < len(words)) & (bt < len(words))
        live, at, bt = live[inside], at[inside], bt[inside]
        same = words[at] == words[bt]
        out[live[same]] += _CHUNK
        odd, x, y = live[~same], at[~same], bt[~same]
        for _ in range(_CHUNK - 1):
            go = symbols[x] == symbols[y]
            odd, x, y = odd[go], x[go] + 1, y[go] + 1
            out[odd] += 1
        live = live[same]
        if not len(live):
            break
    return out


@dataclass(frozen=True)
class RunIndex:
    """Arrays with one entry a run of the transform; ``size`` is the length of the text in symbols."""

    size: int
    symbols: np.ndarray
    rows: np.ndarray
    heads: np.ndarray
    tails: np.ndarray
    common: np.ndarray

    def matches(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals (first, last) of text positions whose matching statistic is ``least`` or more."""
        places = np.concatenate([self.heads[1:], self.tails[:-1]])
        lengths = np.tile(self.common[1:], 2)
        order = np.argsort(places, kind="stable")
        places = places[order]
        reach = np.maximum.accumulate(places + lengths[order]) if len(places) else places
        last = np.minimum(np.append(places[1:], self.size)[: len(places)] - 1, reach - least)
        some = last >= places
        return places[some], last[some]


def build(symbols: np.ndarray, size: int, depth: int) -> RunIndex:
    """The index of ``size`` symbols whose suffixes differ within ``depth``."""
    words = _words(symbols, size)
    order = _suffix_array(words, depth)
    before = np.where(order == 0, np.uint64(511), symbols[order - 1])  # the transform; 511 stands before the text
    rows = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    heads, tails = order[rows], order[np.append(rows[1:], size) - 1]
    common = np.zeros(len(rows), dtype=np.int64)
    common[1:] = _common(words, symbols, tails[:-1], heads[1:], depth)
    return RunIndex(size, before[rows].astype(np.uint16), rows, heads, tails, common)


def repeated_windows(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (string, first offset, last offset) at which ``window`` bytes start that start anywhere else too."""
    if len(strings) >= 1 << 24:
        raise ValueError("an index numbers its strings with 24 bits")
    if not strings:
        return (np.zeros(0, dtype=np.int64),) * 3
    symbols, starts = _symbols(strings)
    index = build(symbols, len(symbols) - 2 * _CHUNK, max(len(s) for s in strings) + 8)
    low, high = index.matches(window)
    number = np.searchsorted(starts, high, side="right") - 1  # an interval may begin in the separator before
    high = np.minimum(high - starts[number], np.array([len(s) for s in strings])[number] - window)
    low = np.maximum(low - starts[number], 0)
    some = high >= low
    return number[some], low[some], high[some]
