"""Assign documents to shards by balanced label propagation, with DataFrame functions only.

Linked documents start on hashed shards. In each round every document looks at the shards
of its groups' members (itself included) and asks to move to the commonest. Moves are
granted as far as a shard's quota has room, where departures count, so full shards swap
equal numbers; those with the most neighbours go first. A shard that refused moves gets no
votes from elsewhere until no other move is left. Rounds end when none is granted at all.
Documents without links then fill what room is left, so that row counts differ by one at
most.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprov.llm.folders import stored
from corpusprov.operators.ordering import number_rows

#: Moves of one shard and number of neighbours are granted in so many hashed portions.
PORTIONS = 64


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _sums(df: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy("shard").count().collect()}  # one row a shard
    return [found.get(s, 0) for s in range(shards)]


def grants(asked: np.ndarray, room: list[int]) -> np.ndarray:
    """How many of the moves asked for (from by to) to grant, so that no shard outgrows its room.

    Equal numbers in both directions always go; of the rest, moves into a shard beyond its
    room and its departures are cut in proportion until all fit.
    """
    both = np.minimum(asked, asked.T)
    rest = asked - both
    cut = True
    while cut:
        cut = False
        for to, free in enumerate(room):
            over = int(rest[:, to].sum() - rest[to].sum()) - free
            if over > 0:
                upto = np.cumsum(rest[:, to])
                left = upto * (int(upto[-1]) - over) // int(upto[-1])
                rest[:, to], cut = np.diff(left, prepend=0), True
    return both + rest


def propagate(members: DataFrame, quotas: list[int], rounds: int | None = None) -> DataFrame:
    """``row`` and ``shard`` of every row of ``members`` (``row``, ``grp``).

    A row may be in several groups. Quotas hold for the rows that have links; a hashed
    start above a quota only shrinks. Equal counts go to the shard that hashes lowest with
    the group, which is the same for all its members. Without ``rounds`` it goes on until no
    move is granted, or until moves bring no more members together, as may be where rows
    are in several groups.
    """
    shards = len(quotas)
    labels = stored(
        members.select("row").distinct().withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")),
        "labels")
    closed: set[int] = set()
    worth, moves, done = -1, False, 0
    while rounds is None or done < rounds:
        room = [max(0, q - n) for q, n in zip(quotas, _sums(labels, shards))]
        placed = members.join(labels, "row").select("row", "grp", F.col("shard").alias("own"))
        near = stored(
            placed.groupBy("grp", F.col("own").alias("shard")).agg(F.count(F.lit(1)).alias("n")), "near")
        # at most ``shards`` rows for each group, however many members it has
        votes = (
            placed.join(near, "grp")
            .where((F.col("shard") == F.col("own")) | ~F.col("shard").isin(sorted(closed)))
            .groupBy("row", "own", "shard")
            .agg(F.sum("n").alias("n"), F.min(F.xxhash64("grp", "shard")).alias("tie")))
        best = votes.groupBy("row", "own").agg(F.max(F.struct("n", -F.col("tie"), "shard")).alias("best"))
        asks = (
            best.select("row", "own", F.col("best.shard").alias("to"), F.floor(F.log2("best.n")).alias("gain"),
                        F.pmod(F.xxhash64("row", F.lit(7)), F.lit(PORTIONS)).alias("portion"))
            .where(F.col("to") != F.col("own")))
        asks = stored(asks, "moves")
        asked = np.zeros((shards, shards), np.int64)
        for r in asks.groupBy("own", "to").count().collect():  # at most a row for two shards
            asked[r[0], r[1]] = r[2]
        allowed = grants(asked, room)
        refused = {s for s in range(shards) if allowed[:, s].sum() < asked[:, s].sum()}
        if not allowed.any():
            if refused:
                closed |= refused
            elif closed and moves:
                closed, moves = set(), False
            else:
                break
            continue
        together = near.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        if together <= worth:
            break
        worth, moves, closed, done = together, True, closed | refused, done + 1
        # a row for two shards, gain and portion; one portion of two shards may be granted in part
        order = Window.partitionBy("own", "to").orderBy(F.desc("gain"), "portion")
        limit = F.get(_numbers(allowed.ravel().tolist()), F.col("own") * shards + F.col("to"))
        portions = (
            asks.groupBy("own", "to", "gain", "portion").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("left", limit - F.sum("n").over(order) + F.col("n")).where("left > 0"))
        going = asks.join(F.broadcast(portions), ["own", "to", "gain", "portion"])
        within = Window.partitionBy("own", "to", "gain", "portion").orderBy("row")
        part = going.where("left < n").withColumn("at", F.row_number().over(within)).where("at <= left")
        moved = going.where("left >= n").select("row", "to").unionByName(part.select("row", "to"))
        labels = stored(
            labels.join(moved, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")), "labels")
    return labels


def equal_texts(rows: DataFrame) -> DataFrame:
    """Members of groups of equal texts: ``row`` and ``grp``, for texts that occur twice or more."""
    many = rows.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(many.select("digest"), "digest").select("row", F.col("digest").alias("grp"))


def shard_rows(rows: DataFrame, members: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows`` (with a unique ``row``): counts differ by one at most.

    A group with more members than a shard has places is split over several.
    """
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    labels = propagate(members, quotas, rounds)
    ranked = number_rows(labels, ["shard"], ["row"], "slot").withColumn("slot", F.col("slot") - 1)
    kept = ranked.where(F.col("slot") < F.get(_numbers(quotas), F.col("shard")))
    kept = stored(kept.select("row", "shard", "slot"), "kept")
    held = _sums(kept, shards)
    ends = list(accumulate(q - n for q, n in zip(quotas, held)))
    pool = rows.select("row").join(kept.select("row"), "row", "left_anti")
    pool = number_rows(pool, [], ["row"], "place").withColumn("place", F.col("place") - 1)
    shard = sum(((F.col("place") >= e).cast("int") for e in ends), F.lit(0))
    starts = [h - e for h, e in zip(held, [0, *ends])]
    filled = pool.withColumn("shard", shard).select(
        "row", "shard", (F.col("place") + F.get(_numbers(starts), F.col("shard"))).alias("slot"))
    return rows.join(kept.unionByName(filled), "row")


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    Null texts have size 8 and no group; empty texts are equal to each other. Null and
    repeated doc_ids are rows like others. Other columns are not read.
    """
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("digest")), "rows")
    return shard_rows(rows, equal_texts(rows), shards, rounds).drop("row", "digest")
