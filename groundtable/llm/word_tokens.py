"""Token ids of whole texts under a public byte-level BPE vocabulary, as its tokenizer gives them.

The ids are those of ``Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False)``, so a
special token's own string in a text becomes that token.  A text in Latin script is cut into
pre-tokens by array operations on its code points, each distinct pre-token is encoded once and
remembered by its characters, and the ids are gathered.  Pre-tokens of a batch are told apart by a
hash, and each is then compared with the first of its hash, character by character; the texts of a
batch where two differ, as special strings do, go through the tokenizer as they are, and so do texts
with other code points or with a special token's string.

Long texts are encoded in slices.  A slice ends before a white space that follows something else, or
between a letter and a number; no pre-token spans such a place and none looks back beyond it, so the
ids are those of the whole text.  Only a run without any such place is longer than a slice.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np

from groundtable.llm.byte_hash import mix

SLICE = 1 << 20  # characters
LATIN_END = 0x250
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CUT = re.compile(r"(?<=\S)(?=\s)|(?<=[^\W\d_])(?=[0-9])|(?<=[0-9])(?=[^\W\d_])")


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of about ``size`` characters whose ids, one after another, are those of the text."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _class_of(point: int) -> int:
    char = chr(point)
    if char.isspace() and point not in range(0x1C, 0x20):
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(char)[0], _OTHER)


_CLASSES = np.array([_class_of(p) for p in range(LATIN_END)], dtype=np.uint8)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_CODES = np.random.RandomState(7).randint(1, 1 << 62, LATIN_END, dtype=np.int64).astype(np.uint64)
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


class WordTokens:
    """Encodes texts; remembers at most ``limit`` distinct pre-tokens between batches."""

    def __init__(self, vocabulary: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self._tool = Tokenizer.from_file(vocabulary)
        self._limit = limit
        self._special = [token.content for token in self._tool.get_added_tokens_decoder().values()]
        pieces = self._tool.get_vocab(with_added_tokens=True)
        self.ends_sentence = np.zeros(max(pieces.values()) + 1, dtype=bool)
        for piece, rank in pieces.items():
            self.ends_sentence[rank] = piece[-1:] in tuple(".!?\u010a") and piece not in self._special
        self._forget()

    def _forget(self) -> None:
        self._places: dict[str, int] = {}
        self._ids = array("I")
        self._starts = array("q", [0])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as an array of unsigned 32-bit integers."""
        out: list[np.ndarray | None] = [None] * len(texts)
        short = [i for i, text in enumerate(texts) if len(text) <= SLICE]
        for i, ids in zip(short, self._encode([texts[i] for i in short])):
            out[i] = ids
        for i, text in enumerate(texts):
            if out[i] is None:
                out[i] = np.concatenate([self._encode([part])[0] for part in slices(text)])
        return out  # type: ignore[return-value]

    def _whole(self, text: str) -> list[int]:
        return self._tool.encode(text, add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        foreign = np.add.reduceat(points >= LATIN_END, offsets[:-1][lengths > 0]) if len(points) else []
        latin = np.zeros(len(texts), dtype=bool)
        latin[np.flatnonzero(lengths > 0)[np.asarray(foreign) == 0]] = True
        for i in np.flatnonzero(latin):
            latin[i] = not any(token in texts[i] for token in self._special)
        for i in np.flatnonzero(~latin):
            out[i] = np.array(self._whole(texts[i]), dtype=np.uint32)
        rows = np.flatnonzero(latin)
        if len(rows):
            if len(rows) < len(texts):
                points = points[np.repeat(latin, lengths)]
            found = self._latin(points, lengths[rows])
            for i, ids in zip(rows, found or (np.array(self._whole(texts[i]), dtype=np.uint32) for i in rows)):
                out[i] = ids
        return out  # type: ignore[return-value]

    def _latin(self, points: np.ndarray, lengths: np.ndarray) -> list[np.ndarray] | None:
        """Ids of texts of Latin code points; None where two pre-tokens have one hash."""
        starts = _pre_tokens(points, lengths)
        ends = np.append(starts[1:], len(points))
        steps = np.full(len(points) + 1, _BASE, dtype=np.uint64)
        steps[0] = 1
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(_CODES[points] * np.multiply.accumulate(steps)[:-1], out=sums[1:])
        steps[1:] = _BASE_INVERSE
        keys = mix((sums[ends] - sums[starts]) * np.multiply.accumulate(steps)[starts])
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        sizes = ends - starts
        like = np.repeat((starts[first][which] - starts), sizes) + np.arange(len(points))  # the same place in the first of a hash
        if (sizes[first][which] != sizes).any() or (points[like] != points).any():
            return None
        if len(self._places) + len(distinct) > self._limit:
            self._forget()
        text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        pieces = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        found = list(map(self._places.get, pieces))
        for i, place in enumerate(found):
            if place is None:
                self._ids.extend(self._whole(pieces[i]))
                found[i] = self._places[pieces[i]] = len(self._starts) - 1
                self._starts.append(len(self._ids))
        places = np.array(found, dtype=np.int64)
        flat = np.array(self._ids, dtype=np.uint32)
        bounds = np.array(self._starts, dtype=np.int64)
        low = bounds[places][which]
        counts = (bounds[places + 1] - bounds[places])[which]
        after = np.cumsum(counts)
        ids = flat[np.repeat(low - (after - counts), counts) + np.arange(after[-1])]
        of_text = np.searchsorted(starts, np.cumsum(lengths))
        return np.split(ids, np.concatenate([[0], after])[of_text][:-1])


def _pre_tokens(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of the vocabulary's published pattern.

    A pre-token is a run of letters, numbers or other signs with at most one blank before it; the
    rest of a run of white space, and an apostrophe with an English ending, stand alone.
    """
    kinds = _CLASSES[points]
    size = len(points)
    text_first = np.zeros(size + 1, dtype=bool)
    text_first[np.cumsum(lengths)] = True
    text_first[0] = True
    before = np.empty(size, dtype=np.uint8)
    before[0], before[1:] = 255, kinds[:-1]
    before[text_first[:-1]] = 255
    space = kinds == _SPACE
    after_blank = np.zeros(size, dtype=bool)
    after_blank[1:] = (points[:-1] == 32) & ~text_first[1:-1]
    start = ~space & (before != kinds) & ~after_blank
    start |= space & (before != _SPACE)
    last_space = np.zeros(size, dtype=bool)  # a white space that something else in its text follows
    last_space[:-1] = space[:-1] & ~space[1:] & ~text_first[1:-1]
    start |= last_space
    start |= text_first[:-1]
    text = None
    for at in np.flatnonzero((points == 39) & start & ~space):
        if at + 1 < size and not text_first[at + 1] and kinds[at + 1] == _LETTER:
            tail = "".join(map(chr, points[at + 1 : at + 3]))
            ending = next((e for e in _CONTRACTIONS if tail.startswith(e) and not text_first[at + 1 : at + 1 + len(e)].any()), None)
            if ending:
                start[at + 1] = False
                stop = at + 1 + len(ending)
                if stop < size and kinds[stop] == _LETTER:
                    start[stop] = True
    return np.flatnonzero(start)
