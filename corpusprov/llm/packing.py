"""Pack documents into sequences of a fixed length by linear grouping and best fit.

Documents longer than a sequence are cut; their full pieces are sequences of their own, and
the rest, at the front, is packed like a short document. What is packed is decided on the
histogram of lengths, which has at most ``capacity`` entries however many documents there are:

1. Large lengths are sorted, dealt into groups of equal cardinality, and rounded up to the
   largest of their group.
2. For these few sizes, the fullest configuration that holds the largest size left is found
   by dynamic programming and used as often as the counts allow.
3. The documents behind the rounded sizes take their places, longest first, which leaves
   gaps of exact length.
4. Small lengths go, longest first, to the tightest gap that holds them.

The outcome is a list of runs: n documents of one length, taken by rank, go to n consecutive
sequences at one offset. A Spark job looks up each document's run by length and rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprov.llm.arrays import slices
from corpusprov.llm.folders import stored
from corpusprov.llm.tokens import encoder


def _configuration(sizes: np.ndarray, counts: np.ndarray, first: int, capacity: int) -> np.ndarray:
    """Multiplicities of the fullest bin that has ``first`` at least once, within counts."""
    room = capacity - int(sizes[first])
    reach = np.full(room + 1, -1, np.int64)  # the last size used to fill exactly so much
    reach[0] = len(sizes)
    used = np.zeros(room + 1, np.int64)
    for i in range(len(sizes)):
        size, most = int(sizes[i]), int(counts[i]) - (i == first)
        if most <= 0 or size > room:
            continue
        used[:] = 0
        for at in range(size, room + 1):
            if reach[at] < 0 and reach[at - size] >= 0 and used[at - size] < most:
                reach[at] = i
                used[at] = used[at - size] + 1 if reach[at - size] == i else 1
        if reach[room] >= 0:
            break
    fill = int(np.flatnonzero(reach >= 0)[-1])
    out = np.zeros(len(sizes), np.int64)
    out[first] = 1
    while fill:
        i = int(reach[fill])
        out[i] += 1
        fill -= int(sizes[i])
    return out


def plan_runs(
    histogram: dict[int, int], capacity: int, groups: int = 256, small: int | None = None
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset), and the number of sequences.

    Lengths above ``small`` (an eighth of the capacity unless given) count as large.
    """
    small = capacity // 8 if small is None else small
    left = dict(sorted(((n, c) for n, c in histogram.items() if c > 0), reverse=True))
    large = [(n, c) for n, c in left.items() if n > small]
    # 1. groups of equal cardinality, longest first; a length may be split between two
    total, grouped, done, current = sum(c for _, c in large), [], 0, []
    quota = -(-total // groups) if total else 0
    for length, count in large:
        while count:
            take = min(count, quota - done)
            current.append([length, take])
            done, count = done + take, count - take
            if done == quota:
                grouped.append(current)
                current, done = [], 0
    if current:
        grouped.append(current)
    sizes = np.array([g[0][0] for g in grouped], np.int64)
    counts = np.array([sum(c for _, c in g) for g in grouped], np.int64)
    # 2. configurations, 3. substitution
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[list[int]]] = {}  # free tokens: [first sequence, count]
    while counts.any():
        first = int(np.flatnonzero(counts)[0])
        mix = _configuration(sizes, counts, first, capacity)
        times = int((counts[mix > 0] // mix[mix > 0]).min())
        counts -= mix * times
        segments = [[bins, times, 0]]  # first sequence, count, filled
        bins += times
        for g in np.repeat(np.arange(len(sizes)), mix):
            after = []
            for start, n, filled in segments:
                while n:
                    head = grouped[g][0]
                    take = min(n, head[1])
                    runs.append((head[0], rank[head[0]], take, start, filled))
                    after.append([start, take, filled + head[0]])
                    rank[head[0]] += take
                    head[1] -= take
                    start, n = start + take, n - take
                    if not head[1]:
                        grouped[g].pop(0)
            segments = after
        for start, n, filled in segments:
            gaps.setdefault(capacity - filled, []).append([start, n])
    # 4. the tightest gap for each small length
    free = sorted(gaps)
    for length, count in ((n, c) for n, c in left.items() if n <= small):
        while count:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                fit = max(1, capacity // length)
                fresh = -(-count // fit)
                space, spots = capacity, gaps.setdefault(capacity, [])
                spots.append([bins, fresh])
                bins += fresh
                bisect.insort(free, capacity)
                at = len(free) - 1
            space = free[at]
            spots = gaps[space]
            start, n = spots[-1]
            take = min(n, count)
            runs.append((length, rank[length], take, start, capacity - space))
            rank[length] += take
            count -= take
            spots[-1] = [start + take, n - take]
            if n == take:
                spots.pop()
            if not spots:
                del gaps[space]
                free.pop(at)
            rest = space - length
            if rest:
                if rest not in gaps:
                    bisect.insort(free, rest)
                gaps.setdefault(rest, []).append([start, take])
    return runs, bins


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Every document's ids, cut into pieces, by task: the rest first, then full pieces.

    ``rank`` counts rests of one length, and ``full_rank`` full pieces, within a task.
    """
    schema = (
        "doc_id bigint, lengths array<bigint>, crcs array<bigint>, rest bigint, rank bigint, "
        "full_rank bigint, task int"
    )
    names = ["doc_id", "lengths", "crcs", "rest", "rank", "full_rank"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
    end = np.array([end_id], "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        full = 0
        for batch in batches:
            for part in slices(batch):
                ids, at = encode.ids(part.column("text"))
                rows = []
                for k, name in enumerate(part.column("doc_id").to_pylist()):
                    own = np.concatenate([ids[at[k] : at[k + 1]], end])
                    rest = len(own) % capacity
                    cuts = [*([0] if rest else []), *range(rest, len(own) + 1, capacity)]
                    lengths = [b - a for a, b in zip(cuts, cuts[1:])]
                    crcs = [zlib.crc32(own[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                    rows.append((name, lengths, crcs, rest, int(seen[rest]), full))
                    seen[rest] += 1
                    full += len(own) // capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return plain.mapInArrow(pieces, schema.removesuffix(", task int")).withColumn("task", F.spark_partition_id())


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, groups: int = 256
) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Null and empty texts are the end id alone. Null and repeated doc_ids are packed like
    others, row by row. A text of any length is cut, never shortened. Other columns are
    not read. Sequences of several documents have ids from 0, full pieces negative ones.
    """
    spark = docs.sparkSession
    rows = stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    per_task = rows.where("rest > 0").groupBy("rest", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["rest"]: r["n"] for r in per_task.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_runs(histogram, capacity, groups)  # at most ``capacity`` lengths
    earlier = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("rest", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(table)
    fields = ["doc_id", "lengths", "crcs", "full_rank", "task", "sequence", "offset"]
    schema = (
        "doc_id bigint, lengths array<bigint>, crcs array<bigint>, full_rank bigint, task int, "
        "sequence bigint, offset bigint"
    )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, start, offset = sent.value.T
        key = length << 44 | first  # sorted, as runs are
        for batch in batches:
            rest = batch.column("rest").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            if len(key):
                run = np.maximum(np.searchsorted(key, rest << 44 | rank, side="right") - 1, 0)
                sequence, at = start[run] + rank - first[run], offset[run]
            else:
                sequence = at = np.zeros(len(rest), np.int64)
            out = [batch.column(c) for c in fields[:5]] + [pa.array(sequence), pa.array(at)]
            yield pa.RecordBatch.from_arrays(out, names=fields)

    ranked = rows.join(base, ["rest", "task"], "left").withColumn(
        "rank", F.col("rank") + F.coalesce("base", F.lit(0)))
    placed = ranked.select(*fields[:5], "rest", "rank").mapInArrow(places, schema)
    pieces = placed.select("*", F.posexplode("lengths").alias("piece", "length"))
    front = F.get("lengths", F.lit(0)) < capacity
    full = F.col("full_rank") + F.col("piece") - front.cast("int")
    return pieces.select(
        "doc_id", F.col("piece").cast("int"),
        F.when(F.col("piece") == 0, F.lit(0))
        .otherwise(F.get("lengths", F.lit(0)) + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        "length", F.get("crcs", F.col("piece")).alias("ids_crc32"),
        F.when(F.col("length") < capacity, F.col("sequence"))
        .otherwise(-(F.shiftleft(F.col("task").cast("long"), 40) + full + 1)).alias("sequence_id"),
        F.when(F.col("length") < capacity, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"))
