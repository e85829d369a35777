"""Jaccard join of word n-gram sets by size-aware light and heavy ways.

Equal sets are one node. Every n-gram's number of nodes is counted, which drops n-grams that
one node has alone, and with them all nodes that can't reach the threshold on what is left.
What a pair shares is among its kept n-grams, so the rest of the work needs no texts:

* Light sets enumerate the subsets of the fixed size that two sets of their sizes must share.
* Heavy sets put their rarest n-grams, as many as guarantee a common one, into inverted
  lists that are scanned for candidates.
* The boundary is the size at which subsets begin to cost more than lists.

Only components are asked for, so a list isn't expanded into all its pairs: its members are
verified against one of them, and only what is then still in different components meets.

Ways to the count: a task sends each n-gram's low 48 bits and the number of its node within
the flush, in a few byte strings for each range of hashes. An n-gram that many nodes of one
flush have is sent once, as a notice; its range learns from it that the n-gram is common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.arrays import Substrings, lower_ascii, mixed, runs, slices, text_bytes
from corpusprov.llm.components import components
from corpusprov.llm.folders import fresh, stored
from corpusprov.llm.tokens import give_back

#: n-grams and nodes of one flush at most (unless one text has more), and the number of
#: nodes in a flush that makes an n-gram common.
FLUSH, FLUSH_NODES, COMMON = 1_000_000, 60_000, 512
#: A list entry costs as much as so many subsets: it is scanned, and may be verified.
ENTRY_COST = 8
LIGHT_LIMIT = 16

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct word n-grams in ascending order, and where each begins.

    A text of fewer words is one n-gram; one without words or null has none.
    """
    flat, at = text_bytes(column)
    flat = lower_ascii(flat)
    start, end = runs(_WORD[flat], at)
    first = np.searchsorted(start, at)
    size = np.diff(first)
    grams = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    text = np.repeat(np.arange(len(size)), grams)
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    begin = first[text] + np.arange(len(text)) - np.r_[0, np.cumsum(grams)][text]
    sums = Substrings(Substrings(flat).hashes(start, end))
    h = sums.hashes(begin, begin + np.minimum(n, size[text]))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(size) + 1))


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def document_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles and node (digest of the set; null for an empty set)."""
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for part in slices(batch):
                h, at = shingle_sets(part.column("text"), n)
                size = np.diff(at)
                nodes = [set_digest(h[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), pa.array(nodes, pa.binary())],
                    names=["doc_id", "n_shingles", "node"])

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return plain.mapInArrow(sized, "doc_id bigint, n_shingles bigint, node binary")


SENT = pa.schema([
    ("bucket", pa.int32()), ("kind", pa.int32()), ("flush", pa.int64()), ("grams", pa.binary()),
    ("owners", pa.binary()), ("counts", pa.binary()), ("nodes", pa.binary()),
])
SENT_DDL = "bucket int, kind int, flush bigint, grams binary, owners binary, counts binary, nodes binary"
#: Kinds of rows: n-grams to be counted, notices of common ones, n-grams known to be common,
#: the nodes of a flush.
COUNT, NOTICE, KNOWN, NODES = range(4)


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _range(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _sent(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        nodes: dict[bytes, int] = {}
        task, number, size = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, nodes, size
            me = (task << 24) + number
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            h = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.diff(np.r_[new, len(h)])
            common = np.repeat(many >= COMMON, many)
            rows = []
            own = _range(h, buckets)
            for kind, pick in ((COUNT, np.flatnonzero(~common)), (NOTICE, new[many >= COMMON])):
                at = np.searchsorted(own[pick], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(at)).tolist():
                    p = pick[at[b] : at[b + 1]]
                    rows.append((b, kind, me, _six(h[p]), owner[p].tobytes(), b"", b""))
            if common.any():
                rows.append((me % buckets, KNOWN, me, h[common].tobytes(), owner[common].tobytes(), b"", b""))
            rows.append((me % buckets, NODES, me, b"", b"", sizes.astype("<u4").tobytes(), b"".join(nodes)))
            held, nodes, size = [], {}, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SENT.types)], schema=SENT)

        for batch in batches:
            for part in slices(batch):
                task = part.column("task")[0].as_py()
                h, at = shingle_sets(part.column("text"), n)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    if b == a or (node := set_digest(h[a:b])) in nodes:
                        continue
                    nodes[node] = len(nodes)
                    held.append(h[a:b])
                    size += b - a
                    if size >= FLUSH or len(nodes) >= FLUSH_NODES:
                        yield flush()
                        number += 1
        if held:
            yield flush()
        give_back()  # the next stage needs much in the same worker

    return docs.select("text").withColumn("task", F.spark_partition_id()).mapInArrow(send, SENT_DDL)


def _counted(sent: DataFrame, buckets: int) -> DataFrame:
    """The n-grams of each flush that two flushes or nodes have, with their counts.

    One node may be sent by several tasks, so a count of two or more may be of one node;
    that only keeps more n-grams.
    """
    def count(key, table):
        (bucket,) = (k.as_py() for k in key)
        rows, out = table.to_pylist(), []
        told = [r for r in rows if r["kind"] in (COUNT, NOTICE)]
        if told:
            low = [_of_six(r["grams"]) for r in told]
            src = np.repeat(np.arange(len(told), dtype=np.int32), [len(x) for x in low])
            h = np.concatenate(low)
            del low
            owner = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in told])
            weight = np.array([1 if r["kind"] == COUNT else COMMON for r in told], np.int64)
            order = np.argsort(h, kind="stable")
            h, src, owner = h[order], src[order], owner[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            total = np.add.reduceat(weight[src], new)
            df = np.repeat(np.minimum(total, COMMON), np.diff(np.r_[new, len(h)]))
            plain = np.array([r["kind"] == COUNT for r in told])
            keep = (df > 1) & plain[src]
            h, src, owner, df = h[keep], src[keep], owner[keep], df[keep]
            order = np.argsort(src, kind="stable")
            at = np.searchsorted(src[order], np.arange(len(told) + 1))
            high = (np.uint64(bucket) << np.uint64(48)) if bucket < 1 << 16 else np.uint64(0)
            for k in np.flatnonzero(np.diff(at)).tolist():
                p = order[at[k] : at[k + 1]]
                out.append((told[k]["flush"], KNOWN, (h[p] | high).tobytes(), owner[p].tobytes(), df[p].astype("<u2").tobytes(), b""))
        for r in rows:
            if r["kind"] == KNOWN:
                g = np.frombuffer(r["grams"], np.uint64)
                g = (g & _LOW) | _range(g, buckets).astype(np.uint64) << np.uint64(48)
                out.append((r["flush"], KNOWN, g.tobytes(), r["owners"], np.full(len(g), COMMON, "<u2").tobytes(), b""))
            elif r["kind"] == NODES:
                out.append((r["flush"], NODES, b"", b"", r["counts"], r["nodes"]))
        columns = list(zip(*out)) if out else [[]] * 6
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    names = ["flush", "kind", "grams", "owners", "counts", "nodes"]
    return sent.groupBy("bucket").applyInArrow(
        count, "flush bigint, kind int, grams binary, owners binary, counts binary, nodes binary")


def _shared(counted: DataFrame) -> DataFrame:
    """Nodes that may have a partner: node, size, grams (ascending 64-bit), counts (16-bit).

    A partner shares three quarters of the larger set at least, so as much of each must be
    in other nodes too.
    """
    def gather(key, table):
        rows = table.to_pylist()
        head = next(r for r in rows if r["kind"] == NODES)
        size = np.frombuffer(head["counts"], "<u4").astype(np.int64)
        known = [r for r in rows if r["kind"] == KNOWN]
        out: list[tuple] = []
        if known:
            g = np.concatenate([np.frombuffer(r["grams"], np.uint64) for r in known])
            owner = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in known])
            df = np.concatenate([np.frombuffer(r["counts"], "<u2") for r in known])
            order = np.lexsort((g, owner))
            g, owner, df = g[order], owner[order], df[order]
            at = np.searchsorted(owner, np.arange(len(size) + 1))
            for k in np.flatnonzero(4 * np.diff(at) >= 3 * size).tolist():
                a, b = at[k], at[k + 1]
                out.append((head["nodes"][16 * k : 16 * k + 16], int(size[k]), g[a:b].tobytes(), df[a:b].tobytes()))
        columns = list(zip(*out)) if out else [[]] * 4
        types = [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["node", "size", "grams", "counts"])

    rows = counted.groupBy("flush").applyInArrow(gather, "node binary, size bigint, grams binary, counts binary")
    # a set that several flushes sent is the same in each
    return rows.groupBy("node").agg(F.first("size").alias("size"), F.first("grams").alias("grams"), F.first("counts").alias("counts"))


def partner_sizes(size: int) -> range:
    return range(-(-3 * size // 4), 4 * size // 3 + 1)


def shared_sizes(size: int, most: int) -> list[int]:
    """Numbers of common n-grams that sets of this size need with partners of up to ``most``."""
    return sorted({-(-3 * (size + k) // 7) for k in partner_sizes(size) if k <= most})


def light_boundary(histogram: dict[int, int]) -> int:
    """The size up to which enumerating subsets costs no more than scanning lists."""
    best, light, lists, saved = 0, 0, 0, 0
    for size in range(1, LIGHT_LIMIT + 1):
        n = histogram.get(size, 0)
        light += n * sum(comb(size, c) for c in shared_sizes(size, size))
        lists += n * (size - -(-3 * size // 4) + 1) * ENTRY_COST
        if lists - light >= saved:
            best, saved = size, lists - light
    return best


def _keys(nodes: DataFrame, boundary: int) -> DataFrame:
    """Entries of subsets and inverted lists: key, node, size, lone (share of n-grams alone)."""
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, lone = [], [], []
            size = batch.column("size").to_numpy()
            for k, (n, g, c) in enumerate(zip(size.tolist(), batch.column("grams").to_pylist(), batch.column("counts").to_pylist())):
                grams, counts = np.frombuffer(g, np.uint64), np.frombuffer(c, "<u2")
                own = []
                if n <= boundary:
                    for need in shared_sizes(n, boundary):
                        picks = np.array(list(combinations(range(len(grams)), need)), np.int64).reshape(-1, need)
                        own.append(mixed(mixed(grams[picks] + np.uint64(need)).sum(1)))
                if 4 * n > 3 * boundary:  # may meet a heavy set
                    free = n - len(grams)  # n-grams that nobody else has come first
                    prefix = n - -(-3 * n // 4) + 1 - free
                    own.append(grams[np.lexsort((grams, counts))[: max(prefix, 0)]])
                own = np.concatenate(own) if own else np.zeros(0, np.uint64)
                lone.append(1 - len(grams) / n)
                keys.append(own)
                owner.append(np.full(len(own), k))
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            nodes = batch.column("node").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), nodes, pa.array(size[owner]), pa.array(np.array(lone)[owner])],
                names=["key", "node", "size", "lone"])

    return nodes.mapInArrow(enter, "key bigint, node binary, size bigint, lone double")


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` with their number of common n-grams and whether they are linked."""
    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("grams").alias("grams_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("grams").alias("grams_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            x, y = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            common = np.zeros(batch.num_rows, np.int64)
            for k in range(batch.num_rows):
                a = np.frombuffer(batch.column("grams_a")[k].as_buffer(), np.uint64)
                b = np.frombuffer(batch.column("grams_b")[k].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
                common[k] = np.count_nonzero(b[at] == a) if len(b) else 0
            linked = 100 * common >= 75 * (x + y - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(1 - common / (x + y - common)), pa.array(linked)],
                names=["a", "b", "distance", "linked"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(
        verify, "a binary, b binary, distance double, linked boolean")


def _fits(x: str, y: str):
    return (4 * F.col(x) >= 3 * F.col(y)) & (4 * F.col(y) >= 3 * F.col(x))


def _against(asked: DataFrame, nodes: DataFrame, found: DataFrame | None) -> DataFrame:
    """Verified pairs of ``node`` and ``pivot``, without those found before."""
    sizes = nodes.select(F.col("node").alias("pivot"), F.col("size").alias("pivot_size"))
    asked = asked.distinct().join(sizes, "pivot").where(_fits("size", "pivot_size"))
    pairs = asked.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    if found is not None:
        pairs = pairs.join(found.select("a", "b"), ["a", "b"], "left_anti")
    return stored(_verified(pairs, nodes), "verified")


def _placed(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Lists that reach over several components, with each member's component."""
    groups = components(found.where("linked").select("a", "b"), "near")
    placed = lists.drop("component").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    return stored(placed.join(several.select("key"), "key"), "open-lists")


def _differences(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """What sets a member's kept n-grams apart from its pivot's: those it has more, then
    those it lacks, in an order that is the same for all; ``off`` bounds what it must share,
    and ``step`` is its class: a thirty-second of the pivot's size, so classes are few.
    """
    own = nodes.select("node", "grams", "counts")
    other = nodes.select(F.col("node").alias("pivot"), F.col("grams").alias("pivot_grams"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            off, step, parts = [], [], []
            for n, g, c, p in zip(*(batch.column(x).to_pylist() for x in ("size", "grams", "counts", "pivot_grams"))):
                grams, counts, pivot = np.frombuffer(g, np.uint64), np.frombuffer(c, "<u2"), np.frombuffer(p, np.uint64)
                more = ~np.isin(grams, pivot, assume_unique=True)
                extra = grams[more][np.lexsort((grams[more], counts[more]))]
                lacks = pivot[~np.isin(pivot, grams, assume_unique=True)]
                off.append(3 * n / 7 - len(pivot) / 2 + len(lacks))
                step.append(int(off[-1] // max(len(pivot) / 32, 1)))
                parts.append(np.r_[mixed(extra + np.uint64(1)), mixed(lacks)].view(np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum([len(x) for x in parts])], pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("pivot", "node", "size", "component")),
                 pa.array(off, pa.float64()), pa.array(step, pa.int32()), lists],
                names=["pivot", "node", "size", "component", "off", "step", "apart"])

    return members.join(own, "node").join(other, "pivot").mapInArrow(
        differ, "pivot binary, node binary, size bigint, component binary, off double, step int, apart array<bigint>")


def _needed(off):
    """Elements that differences must share, from the sum of both sides' ``off``."""
    return F.greatest(F.ceil(off - 1e-9), F.lit(1)).cast("int")


def _by_differences(members: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates ``a``, ``b`` among members of one pivot that are in different components.

    With P the pivot's kept n-grams, x and y have |P| - lacks(x) - lacks(y) of them in common
    and, beyond that, as many n-grams as their differences from P have in common. So two
    members link only if their differences share off(x) + off(y) elements or more, rounded
    up. Of a pair that is apart one at least isn't linked to the pivot, which makes that
    number large. Members are put into classes by ``off``; two classes meet only where
    differences are long enough for what their members must share, and then by the prefixes
    that must meet, each as short as that pair of classes allows. A pair that needs nothing
    in common is linked to the member with the least ``off``, as is its partner.
    """
    linked = found.where("linked")
    to_pivot = linked.select(F.col("a").alias("node"), F.col("b").alias("pivot")).unionByName(
        linked.select(F.col("b").alias("node"), F.col("a").alias("pivot"))).withColumn("near", F.lit(True))
    apart = stored(_differences(members, nodes).join(to_pivot, ["node", "pivot"], "left"), "apart")
    # at most a few dozen classes of a pivot
    classes = apart.groupBy("pivot", "step").agg(
        F.min("off").alias("low"), F.max(F.size("apart")).alias("long"), F.max(F.col("near").isNull()).alias("far"))
    far = classes.where("far").select("pivot", F.col("step").alias("step_x"), F.col("low").alias("low_x"), F.col("long").alias("long_x"))
    other = classes.select("pivot", F.col("step").alias("step_y"), F.col("low").alias("low_y"), F.col("long").alias("long_y"))
    meet = far.join(other, "pivot").withColumn("need", _needed(F.col("low_x") + F.col("low_y")))
    meet = stored(meet.where("need <= long_x and need <= long_y").select("pivot", "step_x", "step_y", "need"), "classes")

    def entered(side: str, rows: DataFrame) -> DataFrame:
        rows = rows.withColumnRenamed("step", f"step_{side}").join(meet, ["pivot", f"step_{side}"])
        rows = rows.withColumn("long", F.size("apart")).where("need <= long")
        prefix = F.slice("apart", 1, F.col("long") - F.col("need") + 1)
        own = ["node", "size", "component", "near", "off", "long"]
        return rows.select(
            "pivot", "step_x", "step_y", *(F.col(c).alias(f"{c}_{side}") for c in own),
            F.posexplode(prefix).alias(f"at_{side}", "part"))

    # the first element in common has all others behind it, on both sides
    behind = F.least(F.col("long_x") - F.col("at_x"), F.col("long_y") - F.col("at_y"))
    met = entered("x", apart.where("near is null")).join(entered("y", apart), ["pivot", "step_x", "step_y", "part"])
    met = met.where(
        (F.col("component_x") != F.col("component_y")) & _fits("size_x", "size_y")
        & (behind >= _needed(F.col("off_x") + F.col("off_y")))
        & (F.col("near_y").isNotNull() | (F.col("node_x") < F.col("node_y"))))
    met = met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
    least = apart.groupBy("pivot").agg(F.min(F.struct("off", "node")).alias("least"))
    free = apart.join(least, "pivot").where(
        (F.col("off") + F.col("least.off") <= 1e-9) & (F.col("node") != F.col("least.node")))
    free = free.select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"))
    return met.unionByName(free).distinct()


def node_components(nodes: DataFrame, boundary: int, rounds: int = 2) -> DataFrame:
    """``node`` and ``component`` for nodes that have links.

    Each list is scanned against the member with the smallest share of n-grams that no
    other node has, which is likeliest to be the source of the others' copies; then, in
    lists that still reach over several components, against one outside its component.
    """
    entries = _keys(nodes, boundary)
    least, most = F.min(F.struct("lone", "node")), F.max(F.struct("lone", "node"))
    shared = entries.groupBy("key").agg(least.alias("least"), most.alias("most")).where("least != most")
    lists = entries.join(shared.select("key", F.col("least.node").alias("pivot")), "key")
    lists = stored(lists.withColumn("done", F.col("node") == F.col("pivot")), "lists")
    found = _against(lists.where("not done").select("node", "size", "pivot"), nodes, None)
    for _ in range(rounds):
        lists = _placed(lists, found)
        home = lists.where(F.col("node") == F.col("pivot")).select("key", F.col("component").alias("home"))
        outside = lists.join(home, "key").where("not done and component != home")
        following = outside.groupBy("key").agg(least.alias("next")).select("key", F.col("next.node").alias("next"))
        lists = lists.join(following, "key", "left")
        theirs = lists.where(F.col("node") == F.col("next")).select("key", F.col("component").alias("theirs"))
        asked = lists.join(theirs, "key").where("component != theirs").select("node", "size", F.col("next").alias("pivot"))
        found = found.unionByName(_against(asked, nodes, found))
        lists = lists.withColumn("done", F.col("done") | F.coalesce(F.col("node") == F.col("next"), F.lit(False))).drop("next")
    # what is left: members of a list that were not scanned against and are apart
    left = _placed(lists, found).where("not done").select("node", "size", "component", "pivot").distinct()
    rest = _by_differences(left, nodes, found).join(found.select("a", "b"), ["a", "b"], "left_anti")
    links = found.where("linked").select("a", "b").unionByName(_verified(rest, nodes).where("linked").select("a", "b"))
    return components(links, "near")


def jaccard_components(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link at a Jaccard similarity of 0.75 or more. Null texts and texts
    without words are empty sets, each a component of its own. A null doc_id counts for
    nothing in the smallest of a component. Whole texts of any length count; repeated rows
    are in one component; other columns are not read.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = stored(document_sets(docs, n), "sets")
    small = sets.where(F.col("n_shingles").between(1, LIGHT_LIMIT)).groupBy("n_shingles").count().collect()
    boundary = light_boundary({r[0]: r[1] for r in small})  # at most LIGHT_LIMIT rows
    nodes = stored(_shared(_counted(_sent(docs, n, buckets), buckets)), "nodes")
    groups = node_components(nodes, boundary)
    roots = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = roots.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return (
        sets.join(placed.join(least, "component").select("node", "component_id"), "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5) -> DataFrame:
    """Documents with all columns, one row of each component: the smallest doc_id's first row.

    A null doc_id counts as smallest. Documents without words all stay. Rows are told
    apart by their place in ``docs``, which should be a table that is read again alike.
    """
    row = fresh(docs.columns, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), n)
    placed = found.select(F.col("doc_id").alias("row"), "component_id").join(
        rows.select(F.col(row).alias("row"), "doc_id"), "row")
    kept = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    return rows.join(kept.select(F.col("least.row").alias(row)), row, "left_semi").drop(row)
