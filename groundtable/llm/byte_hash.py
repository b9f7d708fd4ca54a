"""Hashes of many byte spans at once, for use inside Arrow batches.

A span's hash is a polynomial over its bytes, read from a prefix sum, so hashing all words or all
windows of a batch costs a few array operations whatever the number of spans.  ``SpanHasher`` counts
modulo 2**64: fast, and fit for choosing anchors and features, but special strings collide.
``FieldHasher`` evaluates two polynomials modulo the prime 2**31 - 1 at unrelated points, 62 bits in
all, and is what stands for a word where equality matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_random = np.random.RandomState(20240117)
BYTE_CODES = _random.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
IS_ALNUM = np.zeros(256, dtype=bool)
IS_ALNUM[48:58] = IS_ALNUM[65:91] = IS_ALNUM[97:123] = IS_ALNUM[128:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse; the one table kept grows by doubling."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        ladder = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            ladder.append(np.multiply.accumulate(steps))
        _powers[size] = (ladder[0], ladder[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of the public SplitMix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """Prefix sums over one byte buffer; ``spans`` hashes any list of [start, end) ranges of it."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = BYTE_CODES):
        powers, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(codes[data] * powers[: len(data)], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])


_PRIME = np.uint64((1 << 31) - 1)
_points = [int(p) for p in _random.randint(1 << 20, (1 << 31) - 1, 2)]
FIELD_CODES = _random.randint(1, (1 << 31) - 1, (2, 256), dtype=np.int64).astype(np.uint64)
FIELD_LOWER_CODES = FIELD_CODES.copy()
FIELD_LOWER_CODES[:, 65:91] = FIELD_CODES[:, 97:123]
_ladders: dict[int, list[np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same residue: below 2**34 for any, below 2**32 for values below 2**62."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _reduce(x: np.ndarray) -> np.ndarray:
    """The residue modulo the prime."""
    x = _fold(_fold(x))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _field_powers(n: int) -> list[np.ndarray]:
    """Powers of both points and of their inverses; the one set of tables kept grows by doubling."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _ladders:
        _ladders.clear()
        made = []
        for base in _points + [pow(p, -1, int(_PRIME)) for p in _points]:
            powers = np.ones(1, dtype=np.uint32)
            while len(powers) < size:
                powers = np.concatenate([powers, _reduce(powers * np.uint64(pow(base, len(powers), int(_PRIME)))).astype(np.uint32)])
            made.append(powers)
        _ladders[size] = made
    return _ladders[size]


class FieldHasher:
    """As SpanHasher, for at most some 2**24 bytes, with hashes that only chance lets collide."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = FIELD_CODES):
        ladders = _field_powers(len(data) + 1)
        self._inverses = ladders[2:]
        self._sums = np.zeros((2, len(data) + 1), dtype=np.uint64)
        for k in (0, 1):
            np.cumsum(_fold(codes[k][data] * ladders[k][: len(data)]), out=self._sums[k, 1:])

    def halves(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = (_reduce(_fold(s[ends] - s[starts]) * i[starts]) for s, i in zip(self._sums, self._inverses))
        return first, second

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        first, second = self.halves(starts, ends)
        return mix((first << np.uint64(32)) | second)


def _long_span(data: np.ndarray, codes: np.ndarray, step: int) -> np.uint64:
    """The field hash of one span, put together from parts of ``step`` bytes."""
    total, shift = [0, 0], [1, 1]
    for at in range(0, len(data), step):
        part = data[at : at + step]
        found = FieldHasher(part, codes).halves(np.zeros(1, dtype=np.int64), np.array([len(part)]))
        for k in (0, 1):
            total[k] = (total[k] + shift[k] * int(found[k][0])) % int(_PRIME)
            shift[k] = shift[k] * pow(_points[k], len(part), int(_PRIME)) % int(_PRIME)
    return mix(np.array([total[0] << 32 | total[1]], dtype=np.uint64))[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, codes: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(field hash, row) of each maximal run of ``member`` bytes.

    A row of more than ``step`` bytes that comes alone is read in parts that end between two words, so the
    arrays stay small however long the row is; several rows are read at once, as the caller cut them.
    """
    if len(data) <= step or len(offsets) > 2:
        starts, ends, rows = runs(member[data], offsets)
        return FieldHasher(data, codes).spans(starts, ends), rows
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + step)
        while end < len(data):  # on to the next byte that is not of a word
            gap = np.flatnonzero(~member[data[end : end + step]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + step)
        part = data[at:end]
        if len(part) > 4 * step:  # ends in a word of at least three times ``step``
            blank = np.flatnonzero(~member[part])
            last = int(blank[-1]) + 1 if len(blank) else 0
            found += [word_hashes(part[:last], np.array([0, last]), member, codes, max(step, last))[0]] if last else []
            found.append(np.array([_long_span(part[last:], codes, step)], dtype=np.uint64))
        else:
            found.append(word_hashes(part, np.array([0, len(part)]), member, codes, 4 * step)[0])
        at = end
    hashes = np.concatenate(found)
    return hashes, np.zeros(len(hashes), dtype=np.int64)


def utf8_parts(array: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary array without nulls into runs of about ``limit`` bytes.

    Yields (first row, row after the last, bytes, offsets of the rows in these bytes).
    One row longer than the limit makes a run of its own; rows are never cut.
    """
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(array):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(len(array), max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a row: (starts, ends, row of each run)."""
    if not len(member):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    first = np.zeros(len(member) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(member), dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | first[:-1]))
    after = np.empty(len(member), dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
