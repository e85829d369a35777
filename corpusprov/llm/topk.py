"""Exact top-k by inner product: tiles of queries times shards, merged as a tree.

Vectors are packed into matrices. Each tile, a block of queries and a shard of candidates,
is one matrix product with a partial selection of k for each query; the short lists are
merged in groups of ``FAN`` until one is left for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a query block and of a candidate shard.
BLOCK, SHARD, FAN = 2048, 4096, 16
LONG = (1 << 63) - 1


def _packed(vectors: DataFrame, scale: float, rows: int) -> DataFrame:
    """Matrices of floor(scale * x), by dimension, with the partition and number of each.

    Vectors that are null, or hold a null or a value that isn't finite, are left out, as
    are those without an id.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        number = 0

        def block(dim: int) -> pa.RecordBatch:
            ids, mats = map(np.concatenate, zip(*held.pop(dim)))
            order = np.argsort(ids, kind="stable")
            row = [part, number, dim, ids[order].tobytes(), mats[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)

        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            batch = batch.filter(pc.and_(batch.column("vec_id").is_valid(), batch.column("embedding").is_valid()))
            vec = batch.column("embedding")
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(size)]
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            sound = bad[at[1:]] == bad[at[:-1]]
            for dim in np.unique(size[sound]).tolist():
                pick = np.flatnonzero(sound & (size == dim))
                mat = np.floor(scale * flat[at[pick][:, None] + np.arange(dim)])
                for a in range(0, len(pick), rows):
                    held.setdefault(dim, []).append((ids[pick[a : a + rows]], mat[a : a + rows]))
                    if sum(len(i) for i, _ in held[dim]) >= rows:
                        yield block(dim)
                        number += 1
        for dim in list(held):
            yield block(dim)
            number += 1

    names = ["part", "number", "dim", "ids", "mat"]
    flat = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return flat.withColumn("part", F.spark_partition_id()).mapInArrow(
        pack, "part bigint, number bigint, dim bigint, ids binary, mat binary")


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products; those beyond 64 bits are held at the ends of their range."""
    most = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1]
    if most < 2**53:
        return (queries @ shard.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    scores = exact(queries) @ exact(shard).T if queries.shape[1] else np.zeros((len(queries), len(shard)), object)
    return np.clip(scores, -LONG, LONG).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of one query's scores, its own row left out, ties to smaller ids.

    ``ids`` are in ascending order.
    """
    keep = np.flatnonzero(ids != own)
    s = scores[keep]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > least)
        level = np.flatnonzero(s == least)[: k - len(above)]
        keep, s = keep[np.r_[above, level]], s[np.r_[above, level]]
    return s, ids[keep]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's best candidates.

    Both tables have ``vec_id`` and ``embedding``. All candidates of the query's dimension
    but rows with its own id take part; a query without any has no rows. A query's
    list has fewer rows where there are fewer candidates. Repeated rows count each.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = _packed(queries.repartition(blocks, F.xxhash64("vec_id")), scale, BLOCK)
    block = F.col("part") * F.lit(1 << 20) + F.col("number")
    left = left.select(
        "dim", block.alias("block"), F.col("ids").alias("query_ids"), F.col("mat").alias("query_mat"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    shard = _packed(candidates, scale, SHARD).withColumn("grp", F.pmod(F.xxhash64("part", "number"), F.lit(groups)).cast("int"))
    tiles = shard.join(left, ["dim", "grp"]).select("grp", "dim", "query_ids", "query_mat", "ids", "mat")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())])
        for batch in batches:
            for t in range(batch.num_rows):
                grp, dim, *rest = (c[t].as_py() for c in batch.columns)
                asked, ids = np.frombuffer(rest[0], np.int64), np.frombuffer(rest[2], np.int64)
                q, m = np.frombuffer(rest[1]).reshape(-1, dim), np.frombuffer(rest[3]).reshape(-1, dim)
                s, n, size = [], [], []
                for a in range(0, len(asked), 512):
                    for own, scores in zip(asked[a : a + 512], products(q[a : a + 512], m)):
                        best, which = best_of(scores, ids, own, k)
                        s.append(-best)
                        n.append(which)
                        size.append(len(best))
                items = pa.StructArray.from_arrays([pa.array(np.concatenate(s)), pa.array(np.concatenate(n))], fields=list(struct))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), items)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked), pa.array(np.full(len(asked), grp), pa.int32()), lists], names=["query_id", "grp", "top"])

    lists = tiles.mapInArrow(select, "query_id bigint, grp int, top array<struct<neg:bigint,vec_id:bigint>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    while True:  # once at least, since shards of one group have a list each
        groups = -(-groups // FAN)
        lists = lists.groupBy("query_id", F.pmod("grp", F.lit(groups)).alias("grp")).agg(best)
        if groups == 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.neg")).alias("score"))
