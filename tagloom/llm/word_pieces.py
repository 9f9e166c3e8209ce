"""Token ids of texts by a file of the tokenizers library.

Where the tokenizer splits texts into runs of letters, single digits and runs of other characters before
it merges, a text is cut at places where such a run must end, equal pieces are encoded once, and their
ids are put together. Texts with one of the special tokens, and all texts of other tokenizers, are
encoded as they are.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tagloom.llm.common import LOWER

#: The normaliser and splitter for which cutting into pieces gives the same ids (fixed values of the tokenizer's file).
CUTTABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
}
#: Pieces whose ids are kept; beyond that all are forgotten.
MOST_KEPT = 400_000

_LETTER, _DIGIT, _OTHER, _APOSTROPHE, _WIDE, _SPACE = range(6)


def _kinds() -> np.ndarray:
    kind = np.full(256, _WIDE, np.uint8)
    kind[:128] = _OTHER
    for a, z in ((65, 91), (97, 123)):
        kind[a:z] = _LETTER
    kind[48:58] = _DIGIT
    kind[39] = _APOSTROPHE
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    return kind


def _cuts() -> np.ndarray:
    """Whether a token must end between two bytes of these kinds: at space, beside a digit, and where ASCII letters and others meet.

    Not between an apostrophe and a letter, which may be one token, nor beside a byte of a longer
    character, which may be a letter, a mark or neither.
    """
    cut = np.zeros((6, 6), bool)
    cut[_DIGIT, :_WIDE] = cut[:_WIDE, _DIGIT] = True
    cut[_LETTER, [_OTHER, _APOSTROPHE]] = cut[_OTHER, _LETTER] = True
    cut[_SPACE, :] = cut[:, _SPACE] = True
    return cut.ravel()


_KIND, _CUT = _kinds(), _cuts()


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a run of texts (ASCII letters lower-cased, without space), and how many each text has."""
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = _CUT[kind[:-1] * 6 + kind[1:]]
    edge[offsets] = True
    start = np.flatnonzero(edge)
    stop, start = start[1:], start[:-1]
    solid = kind[start] != _SPACE if len(start) else np.zeros(0, bool)
    start, stop = start[solid], stop[solid]
    places = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=places[1:])
    packed = LOWER[data[kind != _SPACE]]
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(packed)])
    return found, np.diff(np.searchsorted(start, offsets))


def ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first : first + size] of each row, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class TextEncoder:
    """Ids of texts; equal pieces of all the texts of one worker are encoded once."""

    _last: tuple[str, TextEncoder] | None = None

    @classmethod
    def of(cls, definition: str) -> TextEncoder:
        """The encoder of a tokenizer's file; a worker keeps the last one for its next task."""
        if cls._last is None or cls._last[0] != definition:
            cls._last = (definition, cls(definition))
        return cls._last[1]

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(definition)
        splitters = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.cuttable = parts.get("normalizer") == CUTTABLE["normalizer"] and splitters[0] == CUTTABLE["split"] and len(splitters) == 2
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        plain = [p.isascii() and b"'" not in p and p.decode().isprintable() for p in new]  # one run of characters that no step changes
        tell = self.tokenizer.model.tokenize
        rest = iter(self.tokenizer.encode_batch_fast([p.decode() for p, easy in zip(new, plain) if not easy], add_special_tokens=False))
        for piece, easy in zip(new, plain):
            own = [t.id for t in tell(piece.decode())] if easy else next(rest).ids
            n = len(self.number)
            if n == len(self.first):
                self.first, self.size = np.resize(self.first, 2 * n), np.resize(self.size, 2 * n)
            if self.used + len(own) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + len(own)))
            self.ids[self.used : self.used + len(own)] = own
            self.first[n], self.size[n] = self.used, len(own)
            self.number[piece] = n
            self.used += len(own)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:z].tobytes().decode() for a, z in zip(offsets, offsets[1:])]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(i, np.uint32) for i in found)]), np.array([len(i) for i in found], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has) of UTF-8 texts; an empty text has none."""
        whole = data.tobytes()
        if not self.cuttable or any(s in whole for s in self.special):
            if self.cuttable and len(offsets) > 2:  # row by row, so that only texts with a special token are encoded as they are
                both = [self.encode(data[a:z], np.array([0, z - a])) for a, z in zip(offsets, offsets[1:])]
                return np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
            return self._plain(data, offsets)
        found, count = pieces(data, offsets)
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) + len(distinct) > MOST_KEPT:
            self._forget()
        self._learn([p for p in distinct if p not in self.number])
        numbers = np.array([self.number[p] for p in distinct], np.int64)[coded.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        size = self.size[numbers]
        ends = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(count)
        return ragged(self.ids, self.first[numbers], size), ends[stop] - ends[stop - count]
