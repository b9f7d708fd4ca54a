"""CRC-32 of any substring of a buffer from two running CRCs.

The register of CRC-32 is linear over GF(2): after bytes x and then y it is A^|y|(R(x)) xor R(y), where
A appends a zero byte and R starts from zero.  So with the running register R(i) of every prefix, the
register of bytes [s, e) alone is R(e) xor A^(e-s)(R(s)): the shifted prefix cancels.  The usual
preset and final complement depend on the length only and are shifted in with R(s).

The running registers are computed in rows of ``ROW`` bytes side by side, from zero in each row; the
register at a row's start is carried down by doubling steps and shifted in where a place is asked for.
A^n is kept as four tables of 256 entries, one for each byte of the register, made when n first occurs.
"""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = 0xEDB88320
_FULL = np.uint32(0xFFFFFFFF)
ROW = 64
_NEAR = 128  # shifts below this are one table look-up, longer ones one for each bit of the rest


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_BYTE = _byte_table()


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The operator of ``tables`` (4 x 256) on registers."""
    return (
        tables[0][values & 255] ^ tables[1][(values >> 8) & 255] ^ tables[2][(values >> 16) & 255] ^ tables[3][values >> 24]
    )


def _identity() -> np.ndarray:
    return np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]


def _one_byte() -> np.ndarray:
    start = _identity()
    return (start >> 8) ^ _BYTE[start & 255]


class _Shifts:
    """Tables of A^n: all of n < ``_NEAR`` in one array, and those of powers of two."""

    def __init__(self) -> None:
        self.near = np.empty((_NEAR, 4, 256), dtype=np.uint32)
        self.near[0] = _identity()
        step = _one_byte()
        for n in range(1, _NEAR):
            self.near[n] = _apply(step, self.near[n - 1])
        self._powers = [step]

    def power(self, k: int) -> np.ndarray:
        """Tables of A^(2^k)."""
        while len(self._powers) <= k:
            self._powers.append(_apply(self._powers[-1], self._powers[-1]))
        return self._powers[k]

    def by(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A^length on each value."""
        at = (lengths % _NEAR) * 1024
        flat = self.near.ravel()
        out = flat[at + (values & 255)]
        for k in (1, 2, 3):
            out ^= flat[at + (((values >> np.uint32(8 * k)) & np.uint32(255)) + np.uint32(256 * k))]
        rest = lengths // _NEAR
        bit = _NEAR.bit_length() - 1
        while rest.any():
            odd = np.flatnonzero(rest & 1)
            out[odd] = _apply(self.power(bit), out[odd])
            rest, bit = rest >> 1, bit + 1
        return out


_shifts: list[_Shifts] = []


class PrefixCrc:
    """Running registers of a buffer; ``spans`` gives the CRC-32 of any [start, end) ranges of it."""

    def __init__(self, data: np.ndarray):
        if not _shifts:
            _shifts.append(_Shifts())
        self._shift = _shifts[0]
        rows = max(1, -(-len(data) // ROW))
        columns = np.zeros((ROW, rows), dtype=np.uint8)
        padded = np.zeros(rows * ROW, dtype=np.uint8)
        padded[: len(data)] = data
        columns[:] = padded.reshape(rows, ROW).T
        self._running = np.empty((ROW + 1, rows), dtype=np.uint32)  # by place in the row, then row
        self._running[0] = 0
        for i in range(ROW):
            before = self._running[i]
            self._running[i + 1] = (before >> 8) ^ _BYTE[(before & 255).astype(np.uint8) ^ columns[i]]
        carried, reach, k = self._running[ROW].copy(), 1, ROW.bit_length() - 1
        while reach < rows:  # after each step a row knows the last 2 * reach rows
            carried[reach:] = carried[reach:] ^ _apply(self._shift.power(k), carried[:-reach])
            reach, k = 2 * reach, k + 1
        self._carried = np.concatenate([np.zeros(1, dtype=np.uint32), carried[:-1]])

    def _places(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bytes of it) of each prefix; the very end belongs to the last row."""
        row = np.minimum(places // ROW, self._running.shape[1] - 1)
        return row, places - row * ROW

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of the ranges; what stands before a row cancels where a range lies in one."""
        first, low = self._places(starts)
        last, high = self._places(ends)
        before, after = self._running[low, first], self._running[high, last]
        cross = np.flatnonzero(first != last)
        before[cross] ^= self._shift.by(self._carried[first[cross]], low[cross])
        after[cross] ^= self._shift.by(self._carried[last[cross]], high[cross])
        return after ^ self._shift.by(before ^ _FULL, ends - starts) ^ _FULL
