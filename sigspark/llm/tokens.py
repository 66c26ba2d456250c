"""Token ids of a byte-level BPE vocabulary, encoded by the tokenizers library, with a memo of pieces.

The library's byte-level pre-tokenizer always cuts where white space follows another character, behind a lone line end,
and between a letter, a digit and another mark (but for letters behind an apostrophe); what it does behind such a cut
doesn't depend on what stands before.  So a text's ids are the ids of its pieces between these cuts in order.  The cuts
are found in the bytes of many texts at once, and only where those bytes prove them.  Every id comes from the library: it
encodes each distinct piece once, many in one call; texts repeat their words.  Two kinds of text go to the library whole:
those that hold one of the vocabulary's added tokens, which it takes out before it cuts, and all texts of a vocabulary
with another pre-tokenizer.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
MEMO_PIECES = 600_000
MEMO_PIECE_CHARS = 64
SLICE_BYTES = 4 << 20
SPACE = "Ġ"  # how byte-level vocabularies spell a space

_NO_SPACE = re.compile(r"\S+").fullmatch
_LETTER, _DIGIT, _MARK, _WHITE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
for _byte in range(33, 127):
    _CLASS[_byte] = _LETTER if chr(_byte).isalpha() else _DIGIT if chr(_byte).isdigit() else _MARK
_CLASS[[*range(9, 14), 32]] = _WHITE


def begins(data: np.ndarray) -> np.ndarray:
    """Where, in the bytes of UTF-8 text, the pre-tokenizer is sure to cut: a mask of the bytes that a piece begins with."""
    kind = _CLASS[data]
    lead = (data >= 0xC3) & (data <= 0xDF)  # a character of two bytes, none of which is white space
    ends_two = np.zeros(len(data), bool)
    ends_two[1:] = lead[:-1]
    latin = np.zeros(len(data), bool)  # ends a letter from À to ÿ
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[latin] = _LETTER
    shown = (kind > 0) & (kind < _WHITE)
    black = shown | ends_two  # ends a character that isn't white space
    out = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    out[1:] = shown[:-1] & shown[1:] & (before != here) & ((data[:-1] != 0x27) | (here != _LETTER)) & ~latin[1:]
    out[1:] |= (here == _WHITE) & black[:-1]
    out[2:] |= (data[1:-1] == 0x0A) & black[:-2] & ((shown & ~latin) | lead)[2:]
    return out


class PieceEncoder(dict):
    """Encodes texts to ids as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    It is a memo from pieces to ids, of ``itemsize`` bytes each.  At ``MEMO_PIECES`` pieces it becomes the old generation,
    of which only what is used again goes on; no piece of over ``MEMO_PIECE_CHARS`` characters is kept, so memory stays
    bounded on any text.
    """

    def __init__(self, vocabulary: str = VOCABULARY, itemsize: int = 2):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(vocabulary)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << (8 * itemsize):
            raise ValueError(f"ids of {vocabulary} need more than {itemsize} bytes")
        self.itemsize = itemsize
        self.dtype = np.dtype(f"<u{itemsize}")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(vocabulary, encoding="utf-8") as file:
            parts = json.load(file)
        before = parts.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True) and not parts.get("normalizer")
        ends = self._ids("\n").tolist() if self.cuts else []
        self.line_end = ends[0] if len(ends) == 1 else None
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE) for i in range(size)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of a text; a null or empty text has none."""
        return next(self.encode_all(pa.array([text], pa.large_string())))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian ids of each text in order; about ``SLICE_BYTES`` of text are cut and looked up at once."""
        if not len(texts):
            return
        texts = texts.cast(pa.large_string()).fill_null("")
        part = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // SLICE_BYTES
        slices = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for start, end in itertools.pairwise(slices):
            yield from self._encode_slice(texts.slice(start, end - start))

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts go to the library as they are."""
        out = np.full(len(texts), not self.cuts)
        for token in self.added:
            out |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return out

    def _encode_slice(self, texts: pa.Array) -> Iterator[bytes]:
        whole = self._whole(texts)
        if whole.any():
            cut = self._encode_cut(texts.filter(pa.array(~whole)))
            for text, is_whole in zip(texts, whole.tolist(), strict=True):
                yield self._ids(text.as_py()).tobytes() if is_whole else next(cut)
        else:
            yield from self._encode_cut(texts)

    def _encode_cut(self, texts: pa.Array) -> Iterator[bytes]:
        _, places, held = texts.buffers()
        bounds = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        bounds, data = bounds - bounds[0], np.frombuffer(held or b"", np.uint8)[bounds[0] : bounds[-1]]
        mask = begins(data)
        mask[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(mask)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        store, size = self._found(pieces.dictionary.to_pylist())
        index = pieces.indices.to_numpy()
        n = size[index]
        ends = np.r_[0, np.cumsum(n)]
        ids = store[np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[index] - ends[:-1], n)]
        packed = ids.tobytes()
        for start, end in itertools.pairwise((ends[np.searchsorted(starts, bounds)] * self.itemsize).tolist()):
            yield packed[start:end]

    def _found(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one behind another, and how many each has."""
        found = list(map(self.get, pieces))
        fresh = [i for i, ids in enumerate(found) if ids is None]
        if fresh:
            added = [pieces[i] for i in fresh]
            self._add(added)
            for i in fresh:
                found[i] = self[pieces[i]]
            for piece in added:
                if len(piece) > MEMO_PIECE_CHARS:
                    del self[piece]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.itemsize
        return np.frombuffer(b"".join(found), self.dtype), size

    def _add(self, pieces: list[str]) -> None:
        """Put pieces into the memo: from the old generation, or encoded by the library if they are new."""
        if len(self) > MEMO_PIECES:
            self.old = dict(self)
            self.clear()
        words, bare = [], []
        for piece in pieces:
            ids = self.old.get(piece)
            if ids is not None:
                self[piece] = ids
            elif piece[0] == " " and _NO_SPACE(piece, 1):
                words.append(piece)
            elif self.line_end is not None and _NO_SPACE(piece):
                bare.append(piece)
            else:
                self[piece] = self._ids(piece).tobytes()
        # Of a word behind a space only the first id begins with a space; words without one are joined by line ends.
        if words:
            self.update(self._learn(words, "".join(words), lambda ids: np.r_[np.flatnonzero(self.spaced[ids])[1:], len(ids)], 0))
        if bare:
            self.update(self._learn(bare, "\n".join(bare), lambda ids: np.r_[np.flatnonzero(ids == self.line_end), len(ids)], 1))

    def _learn(self, pieces: list[str], joined: str, borders: Callable[[np.ndarray], np.ndarray], gap: int) -> Iterator[tuple[str, bytes]]:
        """(piece, ids) by one call over ``joined``, whose ids end anew at the borders, each followed by ``gap`` ids."""
        ids = self._ids(joined)
        ends = borders(ids)
        if len(ends) != len(pieces):  # a vocabulary that drops or joins characters
            yield from ((p, self._ids(p).tobytes()) for p in pieces)
            return
        packed, n, at = ids.tobytes(), self.itemsize, 0
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            yield piece, packed[at * n : end * n]
            at = end + gap


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, itemsize: int = 2) -> PieceEncoder:
    """The worker process's encoder; a worker keeps it from task to task."""
    return PieceEncoder(vocabulary, itemsize)
