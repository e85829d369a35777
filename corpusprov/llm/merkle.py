"""Merkle manifest of a table: a root digest, and for each row a proof that it belongs there.

Rows of a group are the leaves of the group's tree, in the order of a key; the groups' roots
are the leaves of the top tree. Every ``fan`` consecutive nodes become their digest, until
one node is left.

Proofs come from pointer jumping. A node holds how far up it points and the siblings on that
way, as (left, right) digests for each level. In each round it joins with the node that it
points to, appends that node's segment, and points twice as far, so the number of rounds is
the logarithm of the height. The leaves of one run have one way up, so only runs jump, which
are a ``fan``-th of the rows; a leaf adds the others of its run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.folders import stored
from corpusprov.operators.ordering import broadcast_if_small, number_rows

FAN = 16
PATH = "array<struct<left:string,right:string>>"
#: An ancestor is copied for about so many of the nodes that point to it.
NODES_PER_COPY = 2000


def digest(*texts: Column) -> Column:
    """Lowercase hex sha256 of the texts one after another."""
    return F.sha2(F.concat(*texts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, ``:`` and itself, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["left"], at, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _height(n: int, fan: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: m["digest"]), "")


def _climb(nodes: DataFrame, level: int, most: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """Roots of trees (``tree``, ``node``, ``digest``), and a step (``node``, ``up``, ``left``,
    ``right``, ``level``) from each other node to its parent.

    ``nodes`` has ``tree``, ``node``, ``idx``, ``digest`` and ``n``, the nodes of the tree; ``most``
    is the largest ``n``.
    """
    roots, steps = [], []
    while True:
        roots.append(nodes.where("n = 1").select("tree", "node", "digest"))
        if most <= 1:
            break
        runs = (
            nodes.where("n > 1").withColumn("at", F.floor(F.col("idx") / fan))
            .groupBy("tree", "at")
            .agg(F.array_sort(F.collect_list(F.struct("idx", "node", "digest"))).alias("run"), F.first("n").alias("n")))
        level += 1
        runs = stored(runs.select(
            "tree", F.col("at").alias("idx"), F.concat_ws("/", "tree", F.lit(level), "at").alias("node"),
            F.sha2(_joined(F.col("run")), 256).alias("digest"), F.ceil(F.col("n") / fan).alias("n"), "run"), "runs")
        child = runs.select(F.col("node").alias("up"), "run", F.posexplode("run").alias("k", "child"))
        steps.append(child.select(
            F.col("child.node").alias("node"), "up",
            _joined(F.slice("run", F.lit(1), F.col("k"))).alias("left"),
            _joined(F.slice("run", F.col("k") + 2, F.lit(fan))).alias("right"), F.lit(level - 1).alias("level")))
        nodes, most = runs.drop("run"), -(-most // fan)
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return found, steps


def _ways_up(steps: list[DataFrame], root: str, height: int, rows: int) -> DataFrame:
    """``node`` and ``path`` to the root for each node with a step, by pointer jumping.

    A node at distance d can be the ancestor of ``fan`` ** d others. Its row, which is all
    that the join needs of it, is copied so that none of its copies meets many of these.
    """
    hops = steps[0]
    for s in steps[1:]:
        hops = hops.unionByName(s)
    hops = stored(hops.select("node", "level", "up", F.array(F.struct("left", "right")).alias("path")), "hops")
    far = 1
    while far < height:
        copies = 1 + (rows // NODES_PER_COPY if far > 1 else 0)
        there = hops.where(F.col("level") > far).select(
            F.col("node").alias("via"), F.col("up").alias("next"), F.col("path").alias("rest"),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
        moving = hops.where(F.col("up") != root).withColumn(
            "copy", F.pmod(F.xxhash64("node"), F.lit(copies)).cast("int"))
        met = moving.join(there, (F.col("up") == F.col("via")) & (moving["copy"] == there["copy"])).select(
            "node", "level", F.col("next").alias("up"), F.concat("path", "rest").alias("path"))
        hops = stored(met.unionByName(hops.where(F.col("up") == root)), "hops")
        far *= 2
    return hops.select("node", "path")


def prove(rows: DataFrame, group: str, key: str, carry: Sequence[str] = (), fan: int = FAN) -> DataFrame:
    """``group``, ``key``, ``leaf``, the columns of ``carry``, ``subroot``, ``root`` and ``path`` of each row.

    ``rows`` has the digest of each row as ``leaf``; of its other columns only those named are
    read. Leaves of a group ascend by key, nulls first; rows with one key by their leaf, so
    repeated rows have each a place of its own. Groups ascend bytewise, null first, and a null
    group is a group. A group of one row has that row's leaf as its root, and with one group its
    root is the root. An empty table has no rows and no root. ``carry`` columns must be sortable
    and have none of the names of the result.
    """
    clash = {group, key, *carry} & {"leaf", "subroot", "root", "path"}
    if clash or len({group, key, *carry}) < 2 + len(carry):
        raise ValueError(f"columns can't be told apart: {sorted(clash) or [group, key, *carry]}")
    slim = stored(rows.select(
        F.col(f"`{group}`").alias("grp"), F.col(f"`{key}`").alias("key"), "leaf",
        F.struct(F.lit(0).alias("-"), *[F.col(f"`{c}`") for c in carry]).alias("extra")), "leaves")
    placed = number_rows(slim, ["grp"], ["key", "leaf"], "place")
    groups = stored(number_rows(slim.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), [], ["grp"], "tree"), "groups")
    count, most = groups.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    members = placed.withColumn("idx", F.floor((F.col("place") - 1) / fan)).groupBy("grp", "idx").agg(
        F.array_sort(F.collect_list(F.struct("place", "leaf", "key", "extra"))).alias("members"))
    named = broadcast_if_small(groups.withColumnRenamed("grp", "g"))
    leaves = F.transform("members", lambda m: m["leaf"])
    runs = stored(members.join(named, F.col("grp").eqNullSafe(F.col("g"))).select(
        "grp", "tree", "idx", F.concat_ws("/", "tree", F.lit(1), "idx").alias("node"),
        F.when(F.col("n") == 1, F.col("members")[0]["leaf"]).otherwise(F.sha2(F.array_join(leaves, ""), 256)).alias("digest"),
        F.ceil(F.col("n") / fan).alias("n"), (F.col("n") == 1).alias("lone"), "members"), "members")

    subroots, steps = _climb(runs.select("tree", "node", "idx", "digest", "n"), 1, -(-most // fan), fan)
    subroots = stored(subroots, "subroots")
    tops = subroots.select(F.lit("top").alias("tree"), "node", (F.col("tree") - 1).alias("idx"), "digest", F.lit(count).alias("n"))
    below = max(1, _height(most, fan))
    root, more = _climb(tops, below, count, fan)
    end = root.first()
    height = below + _height(count, fan)
    all_steps = steps + more
    if all_steps:
        ways = _ways_up(all_steps, end["node"], height, -(-slim.count() // fan))
        runs = runs.join(ways, "node", "left")
    else:
        runs = runs.withColumn("path", F.lit(None).cast(PATH))
    named = broadcast_if_small(subroots.select(F.col("tree").alias("t"), F.col("digest").alias("subroot")))
    runs = runs.join(named, F.col("tree") == F.col("t"))
    each = runs.select(
        "grp", "subroot", "lone", F.coalesce("path", F.array().cast(PATH)).alias("way"), "members",
        F.posexplode("members").alias("k", "member"))
    leaves = F.transform("members", lambda m: m["leaf"])
    own = F.array(F.struct(
        F.array_join(F.slice(leaves, F.lit(1), F.col("k")), "").alias("left"),
        F.array_join(F.slice(leaves, F.col("k") + 2, F.lit(fan)), "").alias("right")))
    return each.select(
        F.col("grp").alias(group), F.col("member.key").alias(key), F.col("member.leaf").alias("leaf"),
        *[F.col(f"member.extra.`{c}`").alias(c) for c in carry], "subroot",
        F.lit(end["digest"] if end else None).cast("string").alias("root"),
        F.when(F.col("lone"), F.col("way")).otherwise(F.concat(own, "way")).alias("path"))
