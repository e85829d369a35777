"""Remove long byte strings that occur earlier, by prefix doubling over sampled suffixes.

Every string of ``length`` bytes holds an anchor: the start of the least-hashed ``SEED``
bytes in it, the leftmost of equals. Equal strings have their anchor at the same place, so
only suffixes at anchors need ranks, about one in thirty-five.

1. Suffixes are ranked by their first ``SEED`` bytes. Those whose rank is unique drop out;
   no string around them occurs twice.
2. The rest are reranked by the surroundings of the anchor that strings around it reach.
   Of equal surroundings all but the first are wholly repeated.
3. Surroundings that are left are reranked at the full length: every string around the
   anchor gets a rank, and all but the first of a rank are repeated.

Ranks are hashes of what is ranked, and reranking is a shuffle by them. A task ranks its own
suffixes first, so that a suffix that it has often leaves it once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.arrays import Substrings, mixed, slices, text_bytes

SEED = 32
#: Bytes of text behind one flush.
FLUSH_BYTES = 8 << 20
#: A text beyond this is worked on in overlapping chunks.
CHUNK = 8 << 20
_PLACE = 24
#: Texts of one step; each byte takes about a hundred bytes of memory there.
STEP_BYTES = 1 << 18
_FIRST = -(1 << 63)


def anchors(flat: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors: place, first and last start of the strings that have it, and hash of its seed.

    ``at`` has the bounds of the texts; strings don't cross them.
    """
    width = length - SEED + 1
    n = len(flat) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64)
    sums = Substrings(flat)
    i = np.arange(len(flat) - SEED + 1)
    h = sums.hashes(i, i + SEED)
    key = h >> np.uint64(_PLACE) << np.uint64(_PLACE) | i.astype(np.uint64)
    reach, best = 1, key
    while 2 * reach <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    best = np.minimum(best[:n], best[width - reach : width - reach + n])
    whole = np.zeros(n, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        whole[a : max(a, b - length + 1)] = True
    start = np.flatnonzero(whole)
    place = (best[start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    if not len(place):
        return empty, empty, empty, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(place)] - 1
    return place[new], start[new], start[last], h[place[new]]


def text_anchors(column: pa.Array, length: int):
    """``anchors`` of a slice, in the bytes of all its texts; a long text in chunks."""
    flat, at = text_bytes(column)
    if len(flat) <= CHUNK * 2:
        return flat, at, anchors(flat, at, length)
    parts = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        for c in range(a, max(a + 1, b - length + 1), CHUNK):
            d = min(b, c + CHUNK + length - 1)
            place, lo, hi, h = anchors(flat[c:d], np.array([0, d - c]), length)
            parts.append((place + c, lo + c, hi + c, h))
    return flat, at, tuple(np.concatenate(x) for x in zip(*parts))


def _range(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each seed. Anchors have low hashes, so these are mixed once more."""
    h = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


ASKED = "bucket int, flush bigint, grams binary, owners binary, many binary, docs binary, sizes binary"


def _asked(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Seeds of each flush, once each, and which anchors of the flush have them."""
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    names = [x.split()[0] for x in ASKED.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, docs_in, sizes = [], [], []
        task, number, held = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal seeds, docs_in, sizes, held
            me = (task << 24) + number
            h = np.concatenate(seeds)
            order = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, len(h)])
            known = np.sort(order[np.repeat(count > 1, count)])  # twice in the flush already
            first = order[new]
            own = _range(h[first], buckets)
            order = np.argsort(own, kind="stable")
            first, count, own = first[order], count[order], own[order]
            at = np.searchsorted(own, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(at)).tolist():
                p = slice(at[b], at[b + 1])
                rows.append((b, me, h[first[p]].tobytes(), first[p].astype("<u4").tobytes(), (count[p] > 1).tobytes(), b"", b""))
            rows.append((me % buckets, me, b"", known.astype("<u4").tobytes(), b"", np.concatenate(docs_in).tobytes(), np.concatenate(sizes).astype("<u4").tobytes()))
            seeds, docs_in, sizes, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for part in slices(batch, most=STEP_BYTES):
                task = part.column("task")[0].as_py()
                flat, at, (place, _, _, h) = text_anchors(part.column("text"), length)
                seeds.append(h)
                docs_in.append(part.column("row").to_numpy())
                sizes.append(np.diff(np.searchsorted(place, at)))
                held += len(flat)
                if held >= FLUSH_BYTES:
                    yield flush()
                    number += 1
        if docs_in:
            yield flush()

    return docs.select("row", "text").withColumn("task", F.spark_partition_id()).mapInArrow(ask, ASKED)


def _repeated(asked: DataFrame) -> DataFrame:
    """Anchors of each document that aren't unique: row, owners (their numbers, 32-bit)."""
    def count(key, table):
        rows, out = table.to_pylist(), []
        told = [r for r in rows if r["grams"]]
        if told:
            h = np.concatenate([np.frombuffer(r["grams"], np.uint64) for r in told])
            many = np.concatenate([np.frombuffer(r["many"], bool) for r in told])
            owner = np.concatenate([np.frombuffer(r["owners"], "<u4") for r in told])
            src = np.repeat(np.arange(len(told)), [len(r["many"]) for r in told])
            order = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
            total = np.add.reduceat(np.ones(len(h), np.int64), new)
            # those that are often in their own flush are known there
            keep = order[np.repeat(total > 1, total)]
            keep = np.sort(keep[~many[keep]])
            at = np.searchsorted(src[keep], np.arange(len(told) + 1))
            for k in np.flatnonzero(np.diff(at)).tolist():
                out.append((told[k]["flush"], owner[keep[at[k] : at[k + 1]]].tobytes(), b"", b""))
        out += [(r["flush"], r["owners"], r["docs"], r["sizes"]) for r in rows if not r["grams"]]
        columns = list(zip(*out)) if out else [[]] * 4
        types = [pa.int64(), *[pa.binary()] * 3]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["flush", "owners", "docs", "sizes"])

    def by_document(key, table):
        rows = table.to_pylist()
        head = next(r for r in rows if r["docs"])
        docs, sizes = np.frombuffer(head["docs"], np.int64), np.frombuffer(head["sizes"], "<u4")
        owner = np.sort(np.concatenate([np.frombuffer(r["owners"], "<u4") for r in rows]).astype(np.int64))
        start = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        at = np.searchsorted(owner, start)
        hit = np.flatnonzero(np.diff(at))
        lists = [(owner[at[k] : at[k + 1]] - start[k]).astype("<u4").tobytes() for k in hit.tolist()]
        return pa.Table.from_arrays([pa.array(docs[hit]), pa.array(lists, pa.binary())], names=["row", "owners"])

    told = asked.groupBy("bucket").applyInArrow(count, "flush bigint, owners binary, docs binary, sizes binary")
    return told.groupBy("flush").applyInArrow(by_document, "row bigint, owners binary")


AROUND = "bucket int, seeds binary, places binary, around binary, spans binary"
_PLACES = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
_SPANS = np.dtype([("row", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _surroundings(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Surroundings of the anchors that aren't unique, once for a flush.

    ``spans`` are of strings whose surroundings the flush has earlier.
    """
    before = length - SEED
    types = [pa.int32(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in AROUND.split(", ")]

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            h, place, text, mark = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            order = np.lexsort((place["at"], place["row"], place["doc"], mark))
            new = np.r_[True, mark[order][1:] != mark[order][:-1]]
            late, first = place[order[~new]], order[new]
            spans = np.zeros(len(late), _SPANS)
            spans["row"], spans["start"], spans["end"] = late["row"], late["at"] - late["lo"], late["at"] - late["hi"] + length
            own = _range(h[first], buckets)
            order = np.argsort(own, kind="stable")
            first, own = first[order], own[order]
            at = np.searchsorted(own, np.arange(buckets + 1))
            rows = [
                (b, h[p].tobytes(), place[p].tobytes(), text[p].tobytes(), b"")
                for b in np.flatnonzero(np.diff(at)).tolist() for p in [first[at[b] : at[b + 1]]]]
            if len(spans):
                rows.append((int(spans["row"][0] % buckets), b"", b"", b"", spans.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for part in slices(batch, most=STEP_BYTES):
                flat, at, (place, lo, hi, h) = text_anchors(part.column("text"), length)
                start = np.searchsorted(place, at)
                lists = [np.frombuffer(x, "<u4").astype(np.int64) for x in part.column("owners").to_pylist()]
                pick = np.concatenate([x + s for x, s in zip(lists, start[:-1])])
                doc = np.repeat(np.arange(part.num_rows), [len(x) for x in lists])
                a, h = place[pick], h[pick]
                out = np.zeros(len(pick), _PLACES)
                ids = part.column("doc_id").fill_null(_FIRST).to_numpy()
                out["doc"], out["row"] = ids[doc], part.column("row").to_numpy()[doc]
                out["at"], out["lo"], out["hi"] = a - at[doc], a - lo[pick], a - hi[pick]
                wide = np.zeros(len(flat) + before + length, np.uint8)
                wide[before : before + len(flat)] = flat
                text = np.lib.stride_tricks.sliding_window_view(wide, before + length)[a]
                column = np.arange(-before, length, dtype=np.int16)
                text[column < -out["lo"].astype(np.int16)[:, None]] = 0
                text[column >= (length - out["hi"]).astype(np.int16)[:, None]] = 0
                whole = Substrings(flat).hashes(a - out["lo"], a - out["hi"] + length)
                mark = mixed(whole + mixed((out["lo"].astype(np.uint64) << np.uint64(32)) + out["hi"].astype(np.uint64)))
                held.append((h, out, text, mark))
                size += text.size
                if size >= FLUSH_BYTES:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "row", "text", "owners").mapInArrow(surround, AROUND)


def _later(around: DataFrame, length: int) -> DataFrame:
    """Bytes of repeated strings: row, start, end."""
    before = length - SEED

    def rerank(key, table):
        rows = table.to_pylist()
        spans = [np.frombuffer(r["spans"], _SPANS) for r in rows]
        rows = [r for r in rows if r["places"]]
        if rows:
            place = np.concatenate([np.frombuffer(r["places"], _PLACES) for r in rows])
            text = np.concatenate([np.frombuffer(r["around"], np.uint8) for r in rows]).reshape(len(place), -1)
            # strings before the seed's first occurrence can't be late, nor can lone seeds'
            order = np.lexsort((place["at"], place["row"], place["doc"]))
            place, text = place[order], text[order]
            hashes, entry, shift = [], [], []
            for a in range(0, len(place), 2048):
                part = place[a : a + 2048]
                wide = text.shape[1]
                sums = Substrings(text[a : a + 2048].reshape(-1))
                n = part["lo"] - part["hi"] + 1
                e = np.repeat(np.arange(len(part)), n)
                o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + part["hi"][e]
                begin = e * wide + before - o
                hashes.append(sums.hashes(begin, begin + length))
                entry.append(e + a)
                shift.append(o)
            h, entry, shift = np.concatenate(hashes), np.concatenate(entry), np.concatenate(shift)
            by = np.argsort(h, kind="stable")  # entries are in order already
            late = np.zeros(len(h), bool)
            late[by[1:]] = h[by[1:]] == h[by[:-1]]
            entry, start = entry[late], place["at"][entry[late]] - shift[late]
            order = np.lexsort((start, entry))
            entry, start = entry[order], start[order]
            new = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (start[1:] != start[:-1] + 1)]) if len(entry) else entry
            found = np.zeros(len(new), _SPANS)
            if len(new):
                end = np.r_[new[1:], len(entry)] - 1
                found["row"], found["start"], found["end"] = place["row"][entry[new]], start[new], start[end] + length
            spans.append(found)
        spans = np.concatenate(spans)
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(spans[c])) for c in ("row", "start", "end")], names=["row", "start", "end"])

    return around.groupBy("bucket").applyInArrow(rerank, "row bigint, start bigint, end bigint")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and kept_sha256.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller
    doc_id (null before all), in an earlier row of the same doc_id, or earlier in the row.
    Null texts are empty. Texts shorter than ``length`` stay. Texts of any length count
    whole. Other columns are not read.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.monotonically_increasing_id().alias("row"))
    texts = plain.repartition(buckets, "row")  # shuffled once for both joins
    repeated = _repeated(_asked(plain, length, buckets))
    around = _surroundings(texts.join(repeated, "row"), length, 4 * buckets)
    spans = _later(around, length).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=STEP_BYTES):
                flat, at = text_bytes(part.column("text"))
                change = np.zeros(len(flat) + 1, np.int64)
                lists = part.column("spans")
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                found = lists.drop_null().flatten()
                if len(found):
                    base = np.repeat(at[:-1], sizes)
                    np.add.at(change, base + found.field("start").to_numpy(), 1)
                    np.add.at(change, base + found.field("end").to_numpy(), -1)
                gone = np.cumsum(change[:-1]) > 0
                lost = np.r_[0, np.cumsum(gone)][at]
                edge = np.zeros(len(gone) + 1, np.int64)
                if len(gone):
                    starts = gone & np.r_[True, ~gone[:-1]]
                    starts[at[:-1][at[:-1] < len(gone)]] |= gone[at[:-1][at[:-1] < len(gone)]]
                    edge[1:] = np.cumsum(starts)
                kept = [flat[a:b][~gone[a:b]].tobytes() if c else flat[a:b].tobytes() for a, b, c in zip(at[:-1], at[1:], np.diff(lost))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(lost)), pa.array(np.diff(edge[at])),
                     pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
