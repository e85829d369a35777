"""Byte-level BPE by prefix dynamic programming, exact appends and edits, and decoding.

The ids of every prefix of a piece of text end with one certain token: of all tokens that end
there, the one that fits behind the last token of what is before it. Two tokens fit when merges
of their bytes never cross from one to the other. So a table with the last token of each prefix
is the encoding: from the end, each token leads to the one before it. More bytes only add
entries, and behind an edit entries are made anew until they are again what they were.

Texts are first split by a pattern, and each match is encoded on its own, as the tiktoken
library does. A match may depend on two characters behind it and on none before it.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.arrays import slices

#: Pieces whose ids a Python worker keeps; then it keeps the last so many of the older ones too,
#: until there are as many new ones again. So memory is bounded and frequent pieces stay.
KEPT_PIECES = 250_000
#: Longer pieces are encoded but not kept.
KEPT_BYTES = 64
#: Pairs of tokens whose fit is kept.
KEPT_PAIRS = 600_000
#: Texts of more characters are split into pieces step by step.
SPLIT_AT_ONCE = 1 << 20
#: Marks an entry of a table whose byte is the first of a piece.
FIRST = 1 << 30
#: Not a byte: where a dictionary of further bytes has the token that ends there.
TOKEN = 256
#: Two characters, in bytes.
AHEAD = 8


class Known(dict):
    """Ids of pieces as little-endian 32-bit numbers, kept from text to text."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            own, data = self.vocabulary, piece.encode()
            # the whole piece counts first, also where a vocabulary has no merges for it
            whole = own.ranks.get(data)
            ids = array("i", [whole]) if whole is not None else own.back(own.table(data))
            ids = np.array(ids, "<i4").tobytes()
            if len(data) > KEPT_BYTES:
                return ids
        if len(self) >= KEPT_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Vocabulary:
    """Ranks of byte strings. A rank is the token's id; lower ranks merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.texts = [b""] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.texts[rank] = text
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("each byte must be a token")
        #: For each byte the tokens that begin with it, and so on; at ``TOKEN`` the token that ends.
        self.begins: dict = {}
        for text, rank in ranks.items():
            at = self.begins
            for byte in text:
                at = at.setdefault(byte, {})
            at[TOKEN] = rank
        self.longest = max(map(len, ranks))
        self.fit: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.known = Known(self)

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one of several bytes."""
        if token not in self.parts:
            parts = [bytes([b]) for b in self.texts[token]]
            while len(parts) > 2:
                rank, k = min((self.ranks.get(a + b, FIRST), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    raise ValueError(f"no merges make token {token}")
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.parts[token] = self.ranks[parts[0]], self.ranks[parts[1]]
        return self.parts[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, one behind the other, are encoded as these two.

        Merges are undone from the last to the first on both sides of the border; at no time
        may the tokens that then meet there have a merge that comes earlier than the next one
        undone. Of equal merges the left one comes first.
        """
        key = left << 32 | right
        known = self.fit.get(key)
        if known is not None:
            return known
        before, ok = FIRST, True
        while True:
            if self.ranks.get(self.texts[left] + self.texts[right], FIRST) < before:
                ok = False
                break
            made_left = left if len(self.texts[left]) > 1 else -1
            made_right = right if len(self.texts[right]) > 1 else -1
            if made_left < 0 and made_right < 0:
                break
            if made_left > made_right:
                before, left = left, self.halves(left)[1]
            else:
                before, right = right + 1, self.halves(right)[0]
        if len(self.fit) >= KEPT_PAIRS:
            self.fit.clear()
        self.fit[key] = ok
        return ok

    def extend(self, last: array, piece: bytes, old: Sequence[int] = (), shift: int = 0, same: int | None = None) -> None:
        """Append to ``last`` the last token of each further prefix of ``piece``.

        From byte ``same`` on the bytes are those that ``old`` has ``shift`` earlier; ``old`` has
        entries of one piece. Once as many entries in a row as the longest token has bytes are
        equal to the old ones, those behind them are too.
        """
        done, n = len(last), len(piece)
        last.extend([-1] * (n - done))
        known, begins, equal = self.fit, self.begins, 0
        for start in range(max(0, done - self.longest + 1), n):
            before = last[start - 1] if start else -1
            if same is not None and max(done, same, shift) < start <= len(old) + shift:
                equal = equal + 1 if before == old[start - 1 - shift] else 0
                if equal >= self.longest:
                    break
            at = begins
            for end in range(start, n):  # tokens that begin here go in at their last bytes
                at = at.get(piece[end])
                if at is None:
                    break
                if last[end] < 0 and TOKEN in at:
                    token = at[TOKEN]
                    if start:
                        fit = known.get(before << 32 | token)
                        if not (self.fits(before, token) if fit is None else fit):
                            continue
                    last[end] = token
        else:
            return
        stop = min(n, len(old) + shift)
        last[start:stop] = array("i", old[start - shift : stop - shift])
        if stop < n:
            rest = last[:stop]
            self.extend(rest, piece)
            last[stop:] = rest[stop:]

    def table(self, piece: bytes) -> array:
        last = array("i")
        self.extend(last, piece)
        return last

    def back(self, last: Sequence[int]) -> array:
        """The ids that a table stands for."""
        ids, at = array("i"), len(last)
        while at:
            token = last[at - 1] & ~FIRST
            ids.append(token)
            at -= len(self.texts[token])
        ids.reverse()
        return ids

    def ids(self, text: str) -> bytes:
        if len(text) <= SPLIT_AT_ONCE:
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        out, matches = [], self.pattern.finditer(text)
        while part := [m.group() for m in islice(matches, 100_000)]:
            out.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(out)

    def prefixes(self, text: str) -> array:
        """The table of a text: one entry for each byte, pieces one behind the other."""
        return self.edited(b"", array("i"), 0, 0, text.encode())[1]

    def edited(self, data: bytes, last: array, at: int, removed: int, inserted: bytes) -> tuple[bytes, array]:
        """Text and table after ``removed`` bytes at ``at`` gave way to others.

        Work is done from the piece before the edit to the first piece behind it that begins
        where one began before.
        """
        if not 0 <= at <= at + removed <= len(data):
            raise ValueError("the edit is outside the text")
        shift, same = len(inserted) - removed, at + len(inserted)
        new = b"".join([data[:at], inserted, data[at + removed :]])
        begin = min(max(0, at - AHEAD), max(0, len(last) - 1))
        while begin and not last[begin] & FIRST:
            begin -= 1
        out, place = last[:begin], begin
        for match in self.pattern.finditer(new[begin:].decode()):
            before = place - shift
            if place >= same and (before == len(last) or last[before] & FIRST):
                out.extend(last[before:])
                break
            piece = match.group().encode()
            if match.end() == match.start():
                continue
            entries = self._entries(piece, place, last, at, shift, same)
            entries[0] |= FIRST
            out.extend(entries)
            place += len(piece)
        return new, out

    def _entries(self, piece: bytes, place: int, last: array, at: int, shift: int, same: int) -> array:
        """Entries of a piece, from those of old pieces as far as they hold."""
        entries = array("i")
        if place < at and last[place] & FIRST:
            end = place + 1
            while end < min(at, place + len(piece)) and not last[end] & FIRST:
                end += 1
            entries = last[place:end]
            entries[0] &= ~FIRST
        if len(entries) == len(piece):
            return entries
        start = max(place, same) - shift  # of the old bytes that are again in this piece
        if start >= len(last) or place + len(piece) <= same:
            self.extend(entries, piece)
            return entries
        first = start
        while first and not last[first] & FIRST:
            first -= 1
        end = start + 1
        while end < min(len(last), place + len(piece) - shift) and not last[end] & FIRST:
            end += 1
        old = last[first:end]
        old[0] &= ~FIRST
        self.extend(entries, piece, old, first + shift - place, max(place, same) - place)
        return entries


def read_ranks(path: str) -> dict[bytes, int]:
    """The file has a base64 text and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary for a Python worker."""
    return Vocabulary(read_ranks(path), pattern)


def _names(df: DataFrame, keep: Sequence[str], made: Sequence[str]) -> str:
    """The kept columns as a schema; they must not have the names of made ones."""
    if clash := set(keep) & set(made):
        raise ValueError(f"columns can't be told apart: {sorted(clash)}")
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in keep)


def _lists(parts: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def encode(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",), text: str = "text",
           prefixes: bool = False) -> DataFrame:
    """Columns ``keep`` and the ids of each text, ``ids``; with ``prefixes`` also ``text`` and ``last``.

    ``last`` is the table that ``edit`` goes on from: for each byte the last token of what ends
    there. A null or empty text has no ids. Each row is encoded on its own, so repeated rows and
    rows without an id stay; other columns aren't read. Special tokens are ordinary text.
    """
    schema = _names(docs, keep, ["ids", "text", "last"] if prefixes else ["ids"]) + "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                kept = [part.column(c) for c in keep]
                if prefixes:
                    tables = [np.array(own.prefixes(t), np.int32) for t in texts]
                    ids = [np.array(own.back(t.tolist()), np.int32) for t in tables]
                    yield pa.RecordBatch.from_arrays([*kept, _lists(ids), pa.array(texts), _lists(tables)], [*keep, "ids", "text", "last"])
                else:
                    ids = [np.frombuffer(own.ids(t), "<i4") for t in texts]
                    yield pa.RecordBatch.from_arrays([*kept, _lists(ids)], [*keep, "ids"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    return source.mapInArrow(run, schema + (", text string, last array<int>" if prefixes else ""))


def edit(encoded: DataFrame, path: str, pattern: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows of ``encode(prefixes=True)`` after an edit each, in the same columns.

    ``at`` and ``removed`` count bytes of the text, ``inserted`` takes their place. A null ``at``
    is the end of the text, so that ``inserted`` is appended; a null ``removed`` is 0 and a null
    ``inserted`` nothing. An edit outside the text or within a character is an error.
    """
    schema = _names(encoded, keep, ["ids", "text", "last"]) + "ids array<int>, text string, last array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in batches:
            for part in slices(batch):
                done = []
                for row in part.select(["text", "last", "at", "removed", "inserted"]).to_pylist():
                    data = (row["text"] or "").encode()
                    at = len(data) if row["at"] is None else row["at"]
                    done.append(own.edited(data, array("i", row["last"] or ()), at, row["removed"] or 0, (row["inserted"] or "").encode()))
                tables = [np.array(t, np.int32) for _, t in done]
                ids = [np.array(own.back(t), np.int32) for _, t in done]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], _lists(ids), pa.array([d.decode() for d, _ in done], pa.string()), _lists(tables)],
                    [*keep, "ids", "text", "last"])

    return encoded.select(*[F.col(f"`{c}`") for c in keep], "text", "last", "at", "removed", "inserted").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id", "ids")) -> DataFrame:
    """Columns ``keep`` and the bytes of ``ids`` as ``decoded``; no ids and a null list give none.

    An id that the vocabulary doesn't have is an error.
    """
    schema = _names(encoded, keep, ["decoded"]) + "decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[[*ranks.values()]] = [*map(len, ranks)]
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column("_ids")
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.dtype.kind != "i" or ids.min() < 0 or ids.max() >= len(size) or not size[ids].all()):
                    raise ValueError("ids that the vocabulary doesn't have")
                sizes = size[ids] if len(ids) else np.zeros(0, np.int64)
                ends = np.cumsum(sizes)
                data = b""
                if len(ids):
                    data = flat[np.arange(ends[-1]) + np.repeat(start[ids] - ends + sizes, sizes)].tobytes()
                count = np.cumsum([0, *(x or 0 for x in lists.value_lengths().to_pylist())])
                offsets = np.r_[0, ends][count]
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], out.cast(pa.binary())], [*keep, "decoded"])

    return encoded.select(*[F.col(f"`{c}`") for c in keep], F.col("ids").alias("_ids")).mapInArrow(run, schema)
