"""Exact clusters of domains by their count.

One dimension allows the best clusters there are, those with the least sum of squared
distances: each is a run of neighbouring counts, so it is enough to choose where runs end. A
table over (number of clusters, last count) is filled row by row from running sums, and since
the best place of the last border never moves back as counts are added, each row is filled by
halving: the middle entry first, which bounds where the others look.

All works on the histogram of counts, whose number of rows is bounded by the square root of
twice the URLs (see ``concentration``). Every domain takes part, not a sample.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprov.operators.concentration import count_histogram

# Range of cluster numbers to try, and the number used in the end.
CLUSTER_RANGE = range(3, 11)
CLUSTERS = 7


def _row(before: np.ndarray, k: int, sums: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of the first j counts in ``k`` clusters, and how many of them are in the first k - 1.

    ``before`` has the costs with one cluster less. Of equal costs the first border counts.
    """
    n, one, two = sums
    size = len(n) - 1
    cost, border = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
    left, right = np.array([k]), np.array([size])
    low, high = np.array([k - 1]), np.array([size - 1])
    while len(left):
        middle = (left + right) // 2
        high = np.minimum(high, middle - 1)
        width = high - low + 1
        first = np.cumsum(width) - width
        i = np.repeat(low - first, width) + np.arange(width.sum())
        j = np.repeat(middle, width)
        s = one[j] - one[i]
        value = before[i] + ((two[j] - two[i]) - s * s / (n[j] - n[i]))
        least = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(least, width))
        best = i[hit[np.searchsorted(hit, first)]]
        cost[middle], border[middle] = least, best
        some, rest = left < middle, middle < right
        left, right, low, high = (
            np.r_[left[some], middle[rest] + 1], np.r_[middle[some] - 1, right[rest]],
            np.r_[low[some], best[rest]], np.r_[best[some], np.full(rest.sum(), size - 1)])
        high = np.maximum(high, low)
    return cost, border


def borders(x: np.ndarray, m: np.ndarray, ks: Iterable[int]) -> dict[int, list[int]]:
    """For each number of clusters, where each cluster begins among the ascending counts ``x``.

    ``m`` domains have each count. A number beyond that of the counts is left out.
    """
    x, m = x.astype(np.float64), m.astype(np.float64)
    sums = tuple(np.r_[0.0, np.cumsum(v)] for v in (m, m * x, m * x * x))
    wanted = sorted(k for k in set(ks) if 1 <= k <= len(x))
    n, one, two = (s[1:] for s in sums)
    cost = np.r_[np.inf, two - one * one / n] if len(x) else np.zeros(1)
    table, out = {}, {}
    for k in range(2, max(wanted, default=0) + 1):
        cost, table[k] = _row(cost, k, sums)
    for k in wanted:
        ends, at = [], len(x)
        for c in range(k, 1, -1):
            at = int(table[c][at])
            ends.append(at)
        out[k] = [0, *ends[::-1]]
    return out


def cluster_histogram(counts: DataFrame, ks: Iterable[int], by: list[str] | None = None,
                      value: str = "url_count") -> DataFrame:
    """``(by..., k, cluster, x, m)``: the cluster of each count, for each number ``k`` of clusters.

    Clusters are numbered from 0 by ascending counts. NULL counts take no part. With fewer
    different counts than ``k`` there are no rows for it.
    """
    by, ks = by or [], list(ks)
    hist = count_histogram(counts, by, value)
    if not by:
        hist = hist.withColumn("_all", F.lit(0))
    types = dict(hist.dtypes)

    def label(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("x")
        parts = []
        for k, starts in borders(group["x"].to_numpy(), group["m"].to_numpy(), ks).items():
            cluster = np.searchsorted(starts, np.arange(len(group)), side="right") - 1
            parts.append(group[[*by, "x", "m"]].assign(k=k, cluster=cluster))
        if not parts:
            return group[[*by, "x", "m"]].assign(k=0, cluster=0).iloc[:0]
        return pd.concat(parts)

    schema = "".join(f"`{c}` {types[c]}, " for c in by) + "x bigint, m bigint, k int, cluster int"
    return hist.groupBy(*(by or ["_all"])).applyInPandas(label, schema)


def cluster_ranges(counts: DataFrame, k: int = CLUSTERS, by: list[str] | None = None,
                   value: str = "url_count") -> DataFrame:
    """Smallest and largest count of each of k clusters of domains, and their domains."""
    return cluster_histogram(counts, [k], by, value).groupBy(*(by or []), "cluster").agg(
        F.min("x").alias("min_count"), F.max("x").alias("max_count"), F.sum("m").alias("n_domains"))


def silhouettes(counts: DataFrame, ks: Iterable[int] = CLUSTER_RANGE, by: list[str] | None = None,
                value: str = "url_count") -> DataFrame:
    """``(by..., k, silhouette, chosen)``: mean silhouette of each number of clusters.

    Distances are plain differences of counts. Within a cluster their mean follows from running
    sums; other clusters lie on one side as a whole, so the distance to their mean is the mean
    distance, and the nearest is a neighbour. A domain alone in its cluster has 0. The number
    with the highest mean, the smallest of equals, is ``chosen``.
    """
    group = [*(by or []), "k"]
    ordered = Window.partitionBy(*group, "cluster").orderBy("x")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    labelled = cluster_histogram(counts, ks, by, value)
    x, m = F.col("x").cast("double"), F.col("m").cast("double")
    means = labelled.groupBy(*group, "cluster").agg((F.sum(x * m) / F.sum(m)).alias("mean"))
    beside = Window.partitionBy(*group).orderBy("cluster")
    means = means.withColumn("below", F.lag("mean").over(beside)).withColumn("above", F.lead("mean").over(beside))
    rows = (
        labelled.withColumns({
            "n0": F.coalesce(F.sum(m).over(before), F.lit(0.0)), "s0": F.coalesce(F.sum(x * m).over(before), F.lit(0.0)),
            "n": F.sum(m).over(every), "s": F.sum(x * m).over(every)})
        .join(means, [*group, "cluster"]))
    inside = (x * F.col("n0") - F.col("s0")) + ((F.col("s") - F.col("s0")) - x * (F.col("n") - F.col("n0")))
    a = inside / (F.col("n") - 1)
    b = F.least(x - F.col("below"), F.col("above") - x)
    value_of = F.when(F.col("n") == 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    found = rows.withColumn("value", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(value_of))
    found = found.groupBy(*group).agg((F.sum(F.col("value") * m) / F.sum(m)).alias("silhouette"))
    best = Window.partitionBy(*(by or [])).orderBy(F.desc("silhouette"), "k")
    return found.withColumn("chosen", F.row_number().over(best) == 1)
