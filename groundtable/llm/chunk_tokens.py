"""Token ids under a vocabulary whose tokenizer drops white space, as its plain call gives them.

Such a tokenizer maps every run of white space to one blank before it cuts words, and no word, accent
or special token reaches across white space.  So a text's ids are those of its white-space-free chunks,
one after another; each distinct chunk is encoded once by the tokenizer and remembered by its characters.

* Chunks are cut and told apart for a whole batch by array operations, so one is looked up once a batch.  The
  separators U+001C to U+001F are no white space to the tokenizer, and white space beyond ASCII is made a blank first.
* A run of ASCII signs between Latin letters or white space is a chunk of its own, and letters of ASCII are made lower case
  beforehand where no mark follows, so words are told apart without their signs and cases.  Only signs are cut off that
  on probes leave the ids as they are, and none that special tokens have.
* A lower-case Latin word is one word to the tokenizer, so it goes to its vocabulary model directly, if on probes that
  gives what the whole tokenizer gives.  One of Latin letters has the ids of its lower case.
* Chunks of more than 64 characters are not remembered beyond a call.  Vocabularies have at most 65,536 ids.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

_FAR_SPACES = tuple(chr(c) for c in range(0x80, 0x3001) if chr(c).isspace())
_IN_CHUNK = np.array([b not in b"\t\n\x0b\x0c\r " for b in range(256)])
_ASCII_LARGE = np.array([chr(b).isascii() and chr(b).isupper() for b in range(256)])
_ASCII_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_FAR = 0xC9  # the first byte of letters from U+0240 on; no mark before it joins a letter
_LONG = 64
_LATIN_END = "\u0250"  # letters below it stay one letter each under composition, and in lower case but for the next
_TWO = "\u0130"


def _model_letters(tool) -> dict[int, str] | None:
    """How the tokenizer spells Latin letters for its model; None where probes tell that it does more than that."""
    letters = [chr(c) for c in range(ord(_LATIN_END)) if chr(c).isalpha() and chr(c).lower() == chr(c)]
    table = {ord(c): "".join(part for part, _ in tool.pre_tokenizer.pre_tokenize_str(c)) for c in letters}
    probes = letters + ["".join(letters[i : i + 9]) for i in range(0, len(letters), 3)] + ["reading", "the", "überstraße", "señores", "œuvre"]
    for word in probes:
        if [t.id for t in tool.model.tokenize(word.translate(table))] != tool.encode(word, add_special_tokens=False).ids:
            return None
    return table


def _signs(tool) -> np.ndarray:
    """For each byte, whether it is a sign that the tokenizer parts from Latin letters; never one of a special token."""

    def ids(text: str) -> list[int]:
        return tool.encode(text, add_special_tokens=False).ids

    special = "".join(token.content for token in tool.get_added_tokens_decoder().values())
    out = np.zeros(256, bool)
    for sign in map(chr, range(33, 127)):
        if not sign.isalnum() and sign not in special and sign != "'":
            probes = [("ab", sign, "cd"), ("é", sign * 3, "s"), ("", sign * 2, "ab"), ("don't", sign + "." + sign, "")]
            out[ord(sign)] = all(ids("".join(parts)) == sum((ids(part) for part in parts), []) for parts in probes)
    return out


class _Known(dict):
    """The ids of each chunk as bytes of 16-bit integers; a chunk that neither this nor the generation before knows is encoded."""

    def __init__(self, tool, letters: dict[int, str] | None, before: "_Known | None" = None):
        super().__init__()
        self._letters, self._before, self.long, self.size = letters, before, [], 0
        self._encode, self._model = tool.encode, tool.model.tokenize
        self._plain = letters is not None and all(chr(c) == spelled for c, spelled in letters.items() if c < 128)
        if before is not None:
            before._before = None

    def __missing__(self, chunk: str) -> bytes:
        found = None if self._before is None else self._before.get(chunk)
        if found is None:
            if chunk.isalpha():
                found = self._letters_only(chunk)
            else:
                found = array("H", self._encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = found
        self.size += len(found)
        if len(chunk) > _LONG:
            self.long.append(chunk)
        return found

    def _letters_only(self, chunk: str) -> bytes:
        plain = chunk.isascii()
        if plain or max(chunk) < _LATIN_END and _TWO not in chunk:
            lower = chunk.lower()
            if lower != chunk:
                return self[lower]
            if self._letters is not None:
                return array("H", [t.id for t in self._model(chunk if plain and self._plain else chunk.translate(self._letters))]).tobytes()
        return array("H", self._encode(chunk, add_special_tokens=False).ids).tobytes()


def _near_spaces(text: str) -> str:
    """``text`` with a blank for each white space beyond ASCII."""
    if not text.isascii():
        for space in _FAR_SPACES:
            if space in text:
                text = text.replace(space, " ")
    return text


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the runs of true values start, where they end)."""
    edged = np.zeros(len(inside) + 2, bool)
    edged[1:-1] = inside
    edges = np.flatnonzero(edged[1:] != edged[:-1])
    return edges[::2], edges[1::2]


def _letter(lead: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the two bytes are a Latin letter below U+0240, of one letter in lower case."""
    signs = (lead == 0xC3) & ((last == 0x97) | (last == 0xB7))
    return (lead >= 0xC3) & (lead < _FAR) & (last >= 0x80) & (last < 0xC0) & ~signs & ~((lead == 0xC4) & (last == 0xB0))


def _cuts(read: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Where a run of signs begins after a Latin letter or ends before one; on its other side is such a letter or white space."""
    begin, end = _runs(signs[read])
    padded = np.full(len(read) + 4, 32, np.uint8)
    padded[2:-2] = read
    before, after = padded[begin + 1], padded[end + 2]
    letter_before = _ASCII_LETTER[before] | _letter(padded[begin], before)
    letter_after = _ASCII_LETTER[after] | _letter(after, padded[end + 3])
    whole = (letter_before | ~_IN_CHUNK[before]) & (letter_after | ~_IN_CHUNK[after])
    return np.sort(np.concatenate([begin[whole & letter_before], end[whole & letter_after]]))


def _chunks(joined: bytes, signs: np.ndarray, small: bool) -> tuple[pa.Array, np.ndarray]:
    """(the chunks between white space and signs, where each starts); with ``small`` in lower case where that is ASCII and no mark follows."""
    read = np.frombuffer(joined, np.uint8)
    if small:
        large = _ASCII_LARGE[read]
        large[:-1] &= read[1:] < _FAR
        read = read + (large.view(np.uint8) << 5)
    inside = _IN_CHUNK[read]
    starts, ends = _runs(inside)
    cuts = _cuts(read, signs)
    starts, ends = (np.sort(np.concatenate([edges, cuts]), kind="stable") for edges in (starts, ends))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(read[inside])]), starts


class ChunkTokens:
    """Encodes texts; remembers some ``limit`` distinct chunks between batches and those of a generation before."""

    def __init__(self, vocabulary: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self._tool = Tokenizer.from_file(vocabulary)
        self.size = max(self._tool.get_vocab(with_added_tokens=True).values()) + 1
        if self.size > 1 << 16:
            raise ValueError("a vocabulary of at most 65,536 ids is wanted")
        self._limit = limit
        self._letters, self._signs = _model_letters(self._tool), _signs(self._tool)
        self._special = [token.content.lower().encode() for token in self._tool.get_added_tokens_decoder().values()]
        self._small = all(self._same(large) for large in ("A", "IT'S", "ÀZÉ", "Zß", "QX-B"))
        self._known = _Known(self._tool, self._letters)

    def _same(self, word: str) -> bool:
        return self._tool.encode(word, add_special_tokens=False).ids == self._tool.encode(word.lower(), add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 16-bit integers."""
        known = self._known
        raw = [text.encode() for text in map(_near_spaces, texts)]
        begin = np.cumsum([0] + [len(text) + 1 for text in raw])
        joined = b" ".join(raw)
        low = joined.lower()
        chunks, starts = _chunks(joined, self._signs, self._small and not any(token in low for token in self._special))
        coded = chunks.dictionary_encode()
        found = list(map(known.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        sizes, ids = np.fromiter(map(len, found), np.int64, len(found)) // 2, np.frombuffer(b"".join(found), dtype=np.uint16)
        codes = coded.indices.to_numpy()
        many = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], many) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(starts, begin)].tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for chunk in known.long:
            known.pop(chunk, None)
        known.long = []
        if len(known) > self._limit or known.size > 32 * self._limit:
            self._known = _Known(self._tool, self._letters, known)
        return out
