"""Ranked lexical search: exact top documents of each item, by sparse ball trees.

A document is a vector with an entry for each term of the items that it holds: the term's
weight times its saturated count. An item is the vector of its terms' counts, and the score is
the inner product. Documents are dealt by direction to blocks of a bounded size, and each
block has a tree of balls. A node keeps the centroid of its documents and, for each group of
terms, how far from the centroid any of them is there (its radius). By Cauchy and Schwarz no
document in the node scores above::

    item . centroid + sum over groups of |item in the group| * radius of the group

A tree is searched best-first for each item, and ends at the first bound below the item's
twentieth score so far. Bounds are doubles and rounded up by more than all their errors;
documents in leaves are scored in 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprov.llm.arrays import Substrings, lower_ascii, mixed, runs, slices, text_bytes
from corpusprov.llm.folders import stored

#: Text of the items that are searched for at once.
PART_BYTES = 256 << 10
#: Documents that blocks and first thresholds are fitted to, and directions made of them.
SAMPLE, DIRECTIONS = 1024, 32
#: Directions are told apart in a space of so many hashed terms.
HASHED = 512
#: A block has about so many entries and documents at most, a leaf at most so many documents.
BLOCK_ENTRIES, BLOCK_DOCS, LEAF = 1 << 19, 4096, 16
#: Terms of one direction are in groups by how many documents hold them, in powers of 4.
BANDS = 8
#: Items whose bounds are worked out together.
AT_ONCE = 128
#: Relative slack of distances and bounds; sums of a million doubles err by less.
SLACK = 1e-9

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*b"0123456789", *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Terms:
    """The distinct terms of some items, by the hash of their bytes."""

    def __init__(self, terms: list[bytes]):
        self.size = len(terms)
        length = np.array([*map(len, terms)], np.int64)
        at = np.r_[0, np.cumsum(length)]
        flat = np.frombuffer(b"".join(terms), np.uint8)
        hashes = Substrings(flat).hashes(at[:-1], at[1:])
        order = np.argsort(hashes, kind="stable")
        if len(np.unique(hashes)) < len(terms):
            raise ValueError("two terms have one hash")
        self.hashes, self.number = hashes[order], order
        self.flat, self.start, self.length = flat, at[:-1], length

    def find(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the term at each place of a text, or -1; equal hashes are compared byte by byte."""
        if not self.size or not len(start):
            return np.full(len(start), -1)
        hashes = Substrings(flat).hashes(start, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        found = np.where(self.hashes[at] == hashes, self.number[at], -1)
        some = np.flatnonzero(found >= 0)
        number, size = found[some], (end - start)[some]
        wrong = size != self.length[number]
        found[some[wrong]] = -1
        some, number, size = some[~wrong], number[~wrong], size[~wrong]
        if len(some):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differ = flat[np.repeat(start[some], size) + step] != self.flat[np.repeat(self.start[number], size) + step]
            found[some[np.logical_or.reduceat(differ, np.cumsum(size) - size)]] = -1
        return found


def item_parts(items: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[list[tuple]]:
    """(id, terms) of the items with a term, some at a time; the driver holds one part."""
    plain = items.select("item_id", F.regexp_extract_all(
        F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(TERM), F.lit(0)).alias("terms"),
        F.octet_length("text").alias("size")).where(F.size("terms") > 0)
    total = plain.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(1, -(-total // part_bytes))
    dealt = plain.withColumn("part", F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)))
    for k in range(n):
        if part := [(r[0], r[1]) for r in dealt.where(F.col("part") == k).select("item_id", "terms").collect()]:
            yield part


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id``, ``n`` terms of each document, and which of ``terms`` it holds how often (``term``, ``tf``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        for batch in batches:
            for part in slices(batch):
                flat, at = text_bytes(part.column("text"))
                flat = lower_ascii(flat)
                start, end = runs(_TERM_BYTE[flat], at)
                first = np.searchsorted(start, at)
                found = known.find(flat, start, end)
                held = np.flatnonzero(found >= 0)
                owner = np.searchsorted(first, held, side="right") - 1
                key, tf = np.unique(owner * max(1, known.size) + found[held], return_counts=True)
                ends = np.searchsorted(key, np.arange(part.num_rows + 1) * max(1, known.size)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, known.size), tf)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), *lists], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, term array<int>, tf array<int>")


class Entries:
    """Vectors of some documents: entry values and terms, document by document."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, weights: np.ndarray, docs: int, total: int):
        if isinstance(batch, pa.Table):
            batch = batch.combine_chunks().to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], batch.schema)
        lists = batch.column("term")
        self.ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.r_[0, np.cumsum(size)].astype(np.int64)
        self.term = lists.flatten().to_numpy().astype(np.int64)
        tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
        # whole numbers of any size, so that no product overflows
        m = np.array([75 + 25 * n * docs // total for n in batch.column("n").to_pylist()], np.int64)
        self.owner = np.repeat(np.arange(len(size)), size)
        self.value = weights[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.owner]))

    def hashed(self) -> np.ndarray:
        """Each document's direction in the space of hashed terms."""
        place = self.owner * HASHED + (mixed(self.term) % np.uint64(HASHED)).astype(np.int64)
        out = np.bincount(place, self.value, (len(self.first) - 1) * HASHED).reshape(-1, HASHED)
        return (out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]).astype(np.float32)

    def scores(self, item: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents that stand one behind the other, by an item's counts."""
        a, b = self.first[docs[0]], self.first[docs[-1] + 1]
        sums = np.r_[0, np.cumsum(item[self.term[a:b]] * self.value[a:b])]
        return sums[self.first[docs + 1] - a] - sums[self.first[docs] - a]

    def ordered(self, order: np.ndarray) -> None:
        """Put the documents in another order."""
        size = np.diff(self.first)[order]
        take = np.repeat(self.first[order], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.ids, self.term, self.value = self.ids[order], self.term[take], self.value[take]
        self.first = np.r_[0, np.cumsum(size)]
        self.owner = np.repeat(np.arange(len(size)), size)


def _directions(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``k`` clusters of directions, begun with points far from each other."""
    centres, near = [points[0]], points @ points[0]
    while len(centres) < min(k, len(points)):
        centres.append(points[int(near.argmin())])
        near = np.maximum(near, points @ centres[-1])
    out = np.array(centres)
    for _ in range(rounds):
        at = (points @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, at, points)
        norm = np.linalg.norm(sums, axis=1)
        out[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return out


def _split(points: np.ndarray) -> list[tuple[int, int, int, int]]:
    """A tree over documents: (from, to, left child, right child) of each node, and their order."""
    order, nodes, todo = np.arange(len(points)), [[0, len(points), -1, -1]], [0]
    while todo:
        k = todo.pop()
        a, b = nodes[k][:2]
        if b - a <= LEAF:
            continue
        own = points[order[a:b]]
        two = _directions(own, 2, rounds=3)
        lean = own @ (two[0] - two[-1])
        by = np.argsort(-lean, kind="stable")
        order[a:b] = order[a:b][by]
        # at the border between the two, but never so that the tree gets deep
        cut = a + min(max(int((lean > 0).sum()), (b - a) // 8 + 1), b - a - (b - a) // 8 - 1)
        nodes[k][2:] = [len(nodes), len(nodes) + 1]
        todo += nodes[k][2:]
        nodes += [[a, cut, -1, -1], [cut, b, -1, -1]]
    return nodes, order


class BallTree:
    """A tree of balls over the documents of a block, and the search in it."""

    def __init__(self, entries: Entries, group: np.ndarray, groups: int):
        self.nodes, order = _split(entries.hashed())
        entries.ordered(order)
        self.entries, self.groups = entries, groups
        self.terms, entries.term = np.unique(entries.term, return_inverse=True)
        self.group = group[self.terms]

    def balls(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Centroid and radii of each node."""
        e, width = self.entries, len(self.terms)
        for k, (a, b, _, _) in enumerate(self.nodes):
            part = slice(e.first[a], e.first[b])
            term, value = e.term[part], e.value[part].astype(np.float64)
            centre = np.bincount(term, value, width) / (b - a)
            at = (e.owner[part] - a) * self.groups + self.group[term]
            cells = (b - a) * self.groups
            here = np.bincount(self.group, centre * centre, self.groups)
            far = np.bincount(at, value * (value - 2 * centre[term]), cells).reshape(-1, self.groups) + here
            size = np.bincount(at, value * (value + 2 * centre[term]), cells).reshape(-1, self.groups) + here
            yield k, centre, np.sqrt(np.maximum(far + SLACK * size, 0)).max(axis=0) * (1 + SLACK)

    def search(self, items: Items, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Item, ids and scores of its best ``k`` documents here, of those that score ``least`` or more."""
        centres, radii = np.zeros((len(self.nodes), len(self.terms))), np.zeros((len(self.nodes), self.groups))
        for node, centre, radius in self.balls():
            centres[node], radii[node] = centre, radius
        for a in range(0, items.n, AT_ONCE):
            counts = items.dense(a, min(a + AT_ONCE, items.n), self.terms)
            far = np.sqrt(np.stack([np.bincount(self.group, c * c, self.groups) for c in counts])) if len(self.group) else 0
            bounds = (counts @ centres.T + far @ radii.T) * (1 + SLACK) + 1
            for i, (row, bound) in enumerate(zip(counts, bounds), a):
                found = self._best(row.astype(np.int64), bound, int(least[i]), k)
                if len(found[0]):
                    yield i, *found

    def _best(self, item: np.ndarray, bound: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < least:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            got = self.entries.scores(item, np.arange(a, b))
            some = got >= max(1, least)
            if some.any():
                ids, scores = np.r_[ids, self.entries.ids[a:b][some]], np.r_[scores, got[some]]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, int(scores[-1]))
        return ids, scores


class Items:
    """Counts of the terms of each item."""

    def __init__(self, terms: list[np.ndarray]):
        self.n = len(terms)
        self.first = np.r_[0, np.cumsum([*map(len, terms)])].astype(np.int64)
        self.term = np.concatenate(terms) if terms else np.zeros(0, np.int64)

    def dense(self, a: int, b: int, terms: np.ndarray) -> np.ndarray:
        """Counts of the given terms, a row for each item from ``a`` to ``b``."""
        own = self.term[self.first[a] : self.first[b]]
        row = np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1]))
        if not len(terms):
            return np.zeros((b - a, 0))
        at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        here = terms[at] == own
        return np.bincount(row[here] * len(terms) + at[here], minlength=(b - a) * len(terms)).reshape(b - a, -1).astype(np.float64)


def _search_part(docs: DataFrame, part: list[tuple], k: int) -> DataFrame:
    """``item`` (its place in ``part``), ``doc_id`` and ``score`` of what each block found."""
    spark = docs.sparkSession
    terms = sorted({t.encode() for _, found in part for t in found})
    number = {t: i for i, t in enumerate(terms)}
    items = Items([np.array([number[t.encode()] for t in found], np.int64) for _, found in part])
    counted = stored(term_counts(docs, terms), "terms", "zstd")
    total = counted.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 1
    log = F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("count") + 1))
    held = counted.select(F.explode("term").alias("term")).groupBy("term").count()
    weights = np.zeros(len(terms), np.int64)
    band = np.zeros(len(terms), np.int64)
    for term, weight, count in held.select("term", F.floor(1000 * log), "count").collect():  # terms of this part
        weights[term], band[term] = weight, min(BANDS - 1, (count.bit_length() - 1) // 2)

    ranked = counted.where("doc_id is not null and size(term) > 0")
    sample = ranked.orderBy(F.xxhash64("doc_id", "n", "term"), "doc_id").limit(SAMPLE).toArrow()
    seen = Entries(sample, weights, n_docs, n_terms)
    least = np.zeros(items.n, np.int64)
    if sample.num_rows:
        every = np.arange(sample.num_rows)
        for a in range(items.n):
            scores = np.sort(seen.scores(items.dense(a, a + 1, np.arange(len(terms)))[0].astype(np.int64), every))
            least[a] = scores[-k] if len(scores) >= k else 0
    points = seen.hashed() if sample.num_rows else np.zeros((1, HASHED), np.float32)
    directions = _directions(points, DIRECTIONS)
    # terms of one language or subject belong to the direction where they weigh most
    mass = np.zeros((len(directions), len(terms)))
    if sample.num_rows:
        np.add.at(mass, ((points @ directions.T).argmax(axis=1)[seen.owner], seen.term), seen.value)
    group = mass.argmax(axis=0) * BANDS + band

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                own = Entries(some, weights, n_docs, n_terms)
                at = (own.hashed() @ directions.T).argmax(axis=1)
                spread = (mixed(np.arange(row, row + len(at))) >> np.uint64(33)).astype(np.int32)
                row += len(at)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(at.astype(np.int32)), pa.array(spread)], [*some.schema.names, "direction", "spread"])

    vectors = stored(ranked.mapInArrow(deal, "doc_id bigint, n bigint, term array<int>, tf array<int>, direction int, spread int"), "vectors", "zstd")
    blocks = [1] * len(directions)
    for at, entries, count in vectors.groupBy("direction").agg(F.sum(F.size("term")), F.count(F.lit(1))).collect():
        blocks[at] = max(-(-entries // BLOCK_ENTRIES), -(-count // BLOCK_DOCS))
    shares = F.array(*[F.lit(b) for b in blocks])
    dealt = vectors.withColumn("block", F.col("spread") % F.element_at(shares, F.col("direction") + 1))

    def search(table: pa.Table) -> pa.Table:
        tree = BallTree(Entries(table, weights, n_docs, n_terms), group, len(directions) * BANDS)
        found = [*tree.search(items, least, k)]
        size = [len(ids) for _, ids, _ in found]
        return pa.table({
            "item": np.repeat(np.array([i for i, _, _ in found], np.int64), size),
            "doc_id": np.concatenate([ids for _, ids, _ in found]) if found else np.zeros(0, np.int64),
            "score": np.concatenate([s for _, _, s in found]) if found else np.zeros(0, np.int64)})

    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(part)], "item bigint, item_id bigint")
    hits = dealt.groupBy("direction", "block").applyInArrow(search, "item bigint, doc_id bigint, score bigint")
    return hits.join(F.broadcast(names), "item").select("item", "item_id", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, part_bytes: int = PART_BYTES) -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score`` of each item's best ``k`` documents.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are
    lower-cased. Only scores above 0 count; of equal scores the smaller doc_id comes first.
    Repeated documents and items stand each for themselves, with the same ids. A document
    without an id counts in the statistics but isn't ranked; one without text or terms
    does neither. Items without terms have no rows; an item without an id has rows without one.
    Other columns aren't read. Items are searched for in parts of ``part_bytes`` of text, each a
    pass over the documents, so nothing that is broadcast grows with the tables.
    """
    out = None
    for part in item_parts(items.select(F.col("item_id").cast("long"), "text"), part_bytes):
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found = _search_part(docs, part, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found.select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
