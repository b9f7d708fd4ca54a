"""A context-mixing range coder for token ids, for many independent blocks at once.

Each block starts from the same state, so any block can be read alone.  For the next id of a block
three orders make predictions: order 2 the id that last followed the two ids before, order 1 the one
that last followed the id before, both with a confidence of 0 to 3, and order 0 every id by its
frequency.  First it is coded which order's prediction comes true.  The probabilities of that are a
mixture of four experts (the confidences of order 2, of order 1, of both jointly, and none), whose
counts and weights follow how each has foretold this block; they are renewed after 32, 64, 128... ids
and then every ``RENEW``.  An id that neither order 2 nor 1 foretold is then coded by its frequency.
A carrying range coder of 48 bits turns probabilities into 16-bit words.

Blocks are coded in lock-step, one array operation a step for all blocks, and only with integers, so
every machine decodes alike.
"""

from __future__ import annotations

import numpy as np

RENEW = 512
_EVENT_BITS, _PRIOR_BITS = 16, 18
_STATES = 32
_WHOLE = np.int64(1 << _PRIOR_BITS)
_TOP, _TINY, _LOW, _WORD = np.uint64(1 << 32), np.uint64(1 << 16), np.uint64((1 << 32) - 1), np.uint64(16)
_SURER = np.int32(1 << 16)


def prior_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**18, at least 1 where ``counts`` is positive."""
    total = 1 << _PRIOR_BITS
    some = np.flatnonzero(counts)
    freq = np.zeros(len(counts), dtype=np.int64)
    if not len(some):
        return freq
    freq[some] = np.maximum(1, counts[some] * (total - len(some)) // counts.sum())
    freq[some[np.argmax(counts[some])]] += total - freq.sum()
    return freq


_LOGS = np.rint(256 * (12 - np.log2(np.maximum(np.arange(4097), 1)))).astype(np.int32)  # -256 log2(i / 4096)
_HALVES = np.rint(4096 * 2.0 ** (-np.arange(0, 12 * 256) / 256)).astype(np.int64)  # 4096 * 2**(-i / 256)


def _first_counts() -> np.ndarray:
    """Counts of the events by state at a block's start: the surer a prediction, the likelier it is."""
    out = np.zeros((4, 4, 2, 3), dtype=np.int32)
    for two in range(4):
        for one in range(4):
            for same in range(2):
                out[two, one, same] = ((0, 4, 8, 16)[two], 0 if same else (0, 2, 4, 8)[one], 16)
    return out.reshape(_STATES, 3) + 1


class Lanes:
    """The state of ``lanes`` blocks; ``width`` (a power of two) is the size of their context tables."""

    def __init__(self, lanes: int, width: int):
        self.mask = np.int64(width - 1)
        self.two = np.zeros(lanes * width, dtype=np.int32)  # id, and its confidence above 16 bits
        self.one = np.zeros(lanes * width, dtype=np.int32)
        self.counts = np.tile(_first_counts().reshape(-1), lanes)
        self.events: list[np.ndarray] = []
        lane = np.arange(lanes, dtype=np.int64)
        self.at, self.at_state = lane * width, (lane * _STATES).astype(np.int32)
        self.last, self.mixed_last = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.loss = np.zeros((lanes, 4), dtype=np.int64)
        self.experts: list[np.ndarray] = []
        self._mix()

    def renew(self) -> None:
        """Weigh the experts by the ids since the last time and mix their probabilities anew."""
        new = np.bincount(np.concatenate(self.events), minlength=len(self.counts)).astype(np.int32)
        self.events = []
        self.counts += new
        new = new.reshape(len(self.at), -1)
        for i, expert in enumerate(self.experts):
            self.loss[:, i] += (new * _LOGS[expert].reshape(len(self.at), -1)).sum(axis=1, dtype=np.int64)
        self.loss -= self.loss.min(axis=1, keepdims=True)
        np.minimum(self.loss, len(_HALVES) - 1, out=self.loss)
        self._mix()

    def _mix(self) -> None:
        n = self.counts.reshape(len(self.at), 4, 8, 3)
        by_two, by_one = n.sum(axis=2, keepdims=True, dtype=np.int32), n.sum(axis=1, keepdims=True, dtype=np.int32)
        self.experts = []
        for counts in (by_two, by_one, n, by_one.sum(axis=2, keepdims=True, dtype=np.int32)):
            share = (counts << 12) // counts.sum(axis=3, keepdims=True, dtype=np.int32)
            self.experts.append(np.broadcast_to(share, n.shape))
        weights = np.maximum(_HALVES[self.loss], 16)
        parts = ((weights << 15) // weights.sum(axis=1, keepdims=True)).astype(np.int32)
        first, second = (
            np.maximum(sum(e[..., k] * parts[:, i, None, None] for i, e in enumerate(self.experts)) >> 11, 32).reshape(-1).astype(np.uint32) for k in (0, 1)
        )
        first = np.minimum(first, 65_000)
        self.cuts = first | (np.minimum(first + second, 65_500) << 16)

    def look(self, n: int) -> None:
        """What the orders foretell for the first ``n`` blocks, and where the probabilities change from one to the next."""
        own, at = self.last[:n], self.at[:n]
        hashed = own * 2_654_435_761
        self.i2 = ((hashed + self.mixed_last[:n]) >> 13 & self.mask) + at
        self.i1 = (hashed >> 15 & self.mask) + at
        self.mixed_last[:n] = own * 40_503_777
        self.e2, self.e1 = self.two.take(self.i2), self.one.take(self.i1)
        self.c2, self.c1 = self.e2 & 0xFFFF, self.e1 & 0xFFFF
        self.k2, self.k1 = self.e2 >> 16, self.e1 >> 16
        self.row = (self.k2 << 3) + (self.k1 << 1) + (self.c1 == self.c2) + self.at_state[:n]
        cuts = self.cuts.take(self.row)
        self.cut1, self.cut2 = (cuts & 0xFFFF).astype(np.int64), (cuts >> 16).astype(np.int64)

    def learn(self, n: int, ids: np.ndarray, narrow: np.ndarray, event: np.ndarray) -> None:
        self.events.append(self.row * 3 + event)
        fresh = narrow + _SURER
        for table, at, entry, known, sure in ((self.two, self.i2, self.e2, self.c2, self.k2), (self.one, self.i1, self.e1, self.c1, self.k1)):
            right = entry + ((sure < 3).astype(np.int32) << 16)
            table[at] = np.where(known == narrow, right, np.where(sure > 1, entry - _SURER, fresh))
        self.last[:n] = ids


def _renewals(steps: int) -> set[int]:
    """Steps after which the mixture is renewed."""
    return {32 << k for k in range(5) if 32 << k < RENEW} | set(range(RENEW, steps, RENEW))


def _active(lengths: np.ndarray) -> list[int]:
    """The number of blocks that have an id at each step; blocks come longest first."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()


def encode(ids: np.ndarray, lengths: np.ndarray, prior: np.ndarray, width: int) -> list[bytes]:
    """The coded bytes of each block; ``ids`` is (steps, blocks), ``lengths`` descend."""
    lanes = len(lengths)
    model = Lanes(lanes, width)
    before = np.cumsum(prior) - prior
    low, size = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 48) - 1, dtype=np.uint64)
    words = np.zeros((2 * len(ids) + 4, lanes), dtype=np.uint32)
    flat, place = words.reshape(-1), np.arange(lanes)
    renewals = _renewals(len(ids))
    for step, n in enumerate(_active(lengths)):
        if step in renewals:
            model.renew()
        x = ids[step, :n]
        y = x.astype(np.int32)
        model.look(n)
        one = (model.c1 == y) & (model.k1 > 0)
        two = (model.c2 == y) & (model.k2 > 0)
        start = np.where(two, 0, np.where(one, model.cut1, model.cut2))
        freq = np.where(two, model.cut1, np.where(one, model.cut2, 1 << _EVENT_BITS)) - start
        part = size[:n] >> np.uint64(_EVENT_BITS)
        at, span = low[:n] + part * start.view(np.uint64), part * freq.view(np.uint64)
        known = one | two
        part = span >> np.uint64(_PRIOR_BITS)
        at += part * np.where(known, 0, before.take(x)).view(np.uint64)
        span = part * np.where(known, _WHOLE, prior.take(x)).view(np.uint64)
        model.learn(n, x, y, np.where(two, 0, 2 - one))
        short = span < _TOP
        flat[place[:n]] = at >> np.uint64(32)  # overwritten later unless the place moves on
        place[:n] += short * lanes
        low[:n], size[:n] = np.where(short, (at & _LOW) << _WORD, at), span << (short * _WORD)
        few = np.flatnonzero(size[:n] < _TOP)
        while len(few):
            at, span, spot = low[few], size[few] << _WORD, place[few]
            flat[spot] = at >> np.uint64(32)
            low[few], size[few], place[few] = (at & _LOW) << _WORD, span, spot + lanes
            few = few[span < _TOP]
    for shift in (32, 16, 0):
        flat[place] = (low >> np.uint64(shift)) & np.uint64(0x1FFFF if shift == 32 else 0xFFFF)
        place += lanes
    place //= lanes
    carry = np.zeros(lanes, dtype=np.uint32)
    for row in words[: int(place.max())][::-1]:
        row += carry
        np.right_shift(row, 16, out=carry)
    columns = np.ascontiguousarray(words[: int(place.max())].astype("<u2").T)
    return [columns[i, :k].tobytes() for i, k in enumerate(place.tolist())]


def decode(payloads: list[bytes], lengths: np.ndarray, prior: np.ndarray, width: int) -> np.ndarray:
    """The ids (steps, blocks) of coded blocks, whose ``lengths`` descend."""
    lanes, steps = len(lengths), int(lengths[0])
    model = Lanes(lanes, width)
    before = np.cumsum(prior) - prior
    owner = np.repeat(np.arange(len(prior), dtype=np.int32), prior)  # the id of each part of the frequencies
    if len(owner) != 1 << _PRIOR_BITS:
        raise ValueError("frequencies of token ids do not add up")
    sizes = np.array([len(p) // 2 for p in payloads])
    words = np.zeros((lanes, int(sizes.max()) + 4), dtype="<u2")
    for i, payload in enumerate(payloads):
        words[i, : sizes[i]] = np.frombuffer(payload, dtype="<u2", count=sizes[i])
    flat, place = words.reshape(-1), np.arange(lanes, dtype=np.int64) * words.shape[1]
    stop = place + words.shape[1] - 1
    code, size = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 48) - 1, dtype=np.uint64)
    for _ in range(3):
        code = (code << _WORD) | flat[place]
        place += 1
    out = np.zeros((steps, lanes), dtype=np.uint16)
    renewals = _renewals(steps)
    for step, n in enumerate(_active(lengths)):
        if step in renewals:
            model.renew()
        model.look(n)
        here = code[:n]
        part = size[:n] >> np.uint64(_EVENT_BITS)
        value = here // part
        value = np.minimum(value, np.uint64(65_535), out=value).view(np.int64)
        two, rest = value < model.cut1, value >= model.cut2
        start = np.where(two, 0, np.where(rest, model.cut2, model.cut1))
        freq = np.where(two, model.cut1, np.where(rest, 1 << _EVENT_BITS, model.cut2)) - start
        here = here - part * start.view(np.uint64)
        part = (part * freq.view(np.uint64)) >> np.uint64(_PRIOR_BITS)
        value = here // part
        value = np.minimum(value, np.uint64(_WHOLE - 1), out=value).view(np.int64)
        y = np.where(rest, owner.take(value), np.where(two, model.c2, model.c1))
        x = y.astype(np.int64)
        here -= part * np.where(rest, before.take(x), 0).view(np.uint64)
        span = part * np.where(rest, prior.take(x), _WHOLE).view(np.uint64)
        out[step, :n] = y
        model.learn(n, x, y, 1 - two + rest)
        short = span < _TOP
        code[:n], size[:n] = np.where(short, (here << _WORD) | flat.take(place[:n]), here), span << (short * _WORD)
        place[:n] += short
        few = np.flatnonzero(size[:n] < _TOP)
        while len(few):
            spot, span = np.minimum(place[few], stop[few]), size[few] << _WORD
            code[few], size[few], place[few] = (code[few] << _WORD) | flat[spot], span, spot + 1
            few = few[span < _TOP]
        np.minimum(place, stop, out=place)
    return out
