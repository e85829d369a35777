"""Token ids of whole texts by the tokenizers library, with each piece of text encoded once."""

from __future__ import annotations

import ctypes
import gc
import os
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from corpusprov.llm.arrays import text_bytes

#: Pieces whose ids a Python worker keeps; beyond that it starts anew, so memory is bounded.
KEPT_PIECES = 500_000
#: Longer pieces are encoded but not kept.
KEPT_BYTES = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"]] = True
#: White space, and bytes that may start or end a character that is.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def piece_offsets(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts can be cut so that the ids of the pieces are those of the whole.

    That is before a lone space between two characters that aren't white space, which can
    only be the first character of a token, and between an ASCII letter and an ASCII mark,
    where a run of letters ends. A byte that may belong to other white space forbids a cut.
    """
    n = len(flat)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        space, known = flat == 32, _SPACE[flat]
        cut[1 : n - 1] = space[1:-1] & ~known[:-2] & ~known[2:]
        cut[2 : n - 1] &= ~known[: n - 3] | (flat[1 : n - 2] < 128)
        cut[3 : n - 1] &= ~known[: max(n - 4, 0)] | (flat[2 : max(n - 2, 2)] < 128)
    if n > 1:
        cut[1:n] |= _LETTER[flat[:-1]] & _MARK[flat[1:]]
    cut[at] = True
    cut[0] = cut[n] = True
    return np.flatnonzero(cut)


def binaries(column: pa.Array) -> list[bytes]:
    """The values of a whole array of large binaries without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(column) + 1].tolist()
    flat = data.to_pybytes() if data else b""
    return [flat[a:b] for a, b in zip(at, at[1:])]


class Encoder(dict):
    """Ids of pieces as bytes of little-endian 32-bit numbers, kept from text to text."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces of one space and letters in one go, and keep those that are one word.

        A tokenizer that changes texts first may make several words of such a piece; these are
        encoded each on its own, and so are all pieces of a call where a token or a word isn't
        within one piece.
        """
        new = [p for p in pieces if p not in self and len(p) <= KEPT_BYTES]
        if len(self) + len(new) > KEPT_PIECES:
            self.clear()
        words = [p for p in new if p[:1] == b" " and p[1:].decode().isalpha()]
        for plain in (True, False):
            some = [p for p in words if p.isascii() == plain]
            for i in range(0, len(some), 1024):
                self._learn(some[i : i + 1024], plain)

    def _learn(self, part: list[bytes], plain: bool) -> None:
        texts = [p.decode() for p in part]
        encoded = self.tokenizer.encode("".join(texts), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        word = np.array(encoded.word_ids, np.float64)  # NaN for none
        if plain and len(word) and word[-1] == len(part) - 1:
            # ASCII letters are a word at least, so here each piece is one
            ends = (np.searchsorted(word, np.arange(len(part) + 1)) * 4).tolist()
            self.update((p, ids[a:b]) for p, a, b in zip(part, ends, ends[1:]))
            return
        place = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(word)).reshape(-1, 2)
        start = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        owner = np.searchsorted(start, place[:, 0], side="right") - 1
        inside = (place[:, 0] < place[:, 1]) & (place[:, 1] <= start[np.minimum(owner + 1, len(part))]) & (word >= 0)
        first = np.r_[True, word[1:] != word[:-1]][: len(word)]
        inside[1:] &= (owner[1:] == owner[:-1]) | (first[1:] & (owner[1:] > owner[:-1]))
        one = np.zeros(len(part), bool)
        if inside.all():
            one = np.bincount(owner[first], minlength=len(part)) == 1
            ends = (np.searchsorted(owner, np.arange(len(part) + 1)) * 4).tolist()
            self.update((p, ids[a:b]) for p, a, b, k in zip(part, ends, ends[1:], one.tolist()) if k)
        alone = [texts[k] for k in np.flatnonzero(~one).tolist()]
        for text, e in zip(alone, self.tokenizer.encode_batch(alone, add_special_tokens=False)):
            self[text.encode()] = np.array(e.ids, "<u4").tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        encoded = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        ids = struct.pack(f"<{len(encoded)}I", *encoded)
        if len(piece) <= KEPT_BYTES:
            self[piece] = ids
        return ids

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, and where each text's start (and the end).

        Null and empty texts have none. Texts with the text of a special token aren't cut.
        """
        flat, at = text_bytes(column)
        if not len(flat):
            return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
        offsets = piece_offsets(flat, at)
        data = flat.tobytes()
        for text in self.special:
            found = data.find(text)
            while found >= 0:
                row = np.searchsorted(at, found, side="right") - 1
                inside = (offsets > at[row]) & (offsets < at[row + 1])
                offsets = offsets[~inside]
                found = data.find(text, at[row + 1])
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1,
            [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)],
        ).dictionary_encode()
        distinct = binaries(pieces.dictionary)
        known = list(map(self.get, distinct))
        new = [k for k, ids in enumerate(known) if ids is None]
        if new:
            self.learn([distinct[k] for k in new])
            for k in new:
                known[k] = self[distinct[k]]
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(length) - length
        which = pieces.indices.to_numpy()
        sizes = length[which]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1]) + np.repeat(start[which] - ends + sizes, sizes)
        ids = np.frombuffer(b"".join(known), "<u4")[take]
        return ids, np.r_[0, ends][np.searchsorted(offsets, at)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, whichever of its tasks asks."""
    return Encoder(path)


def give_back() -> None:
    """Free what earlier tasks of other operators left in this Python worker.

    Workers are used again from stage to stage, with the encoders that they keep and with
    memory that the allocators hold.
    """
    encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass
