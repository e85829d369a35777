"""Exact one-dimensional clusters against all ways to cut, and silhouettes by their definition."""

import itertools
import random

import numpy as np
import pytest

from corpusprov.operators import clusters as clu


def cost(points):
    mean = sum(points) / len(points)
    return sum((p - mean) ** 2 for p in points)


def cuts(x, k):
    for ends in itertools.combinations(range(1, len(x)), k - 1):
        yield [0, *ends]


def total(x, m, starts):
    parts = zip(starts, [*starts[1:], len(x)])
    return sum(cost([v for v, n in zip(x[a:b], m[a:b]) for _ in range(n)]) for a, b in parts)


@pytest.mark.parametrize("seed", range(20))
def test_no_other_borders_cost_less(seed):
    rnd = random.Random(seed)
    x = sorted(rnd.sample(range(1, 200), 9))
    m = [rnd.randrange(1, 6) for _ in x]
    found = clu.borders(np.array(x), np.array(m), range(1, 12))
    assert sorted(found) == list(range(1, 10))
    for k, starts in found.items():
        assert len(starts) == k and total(x, m, starts) == pytest.approx(min(total(x, m, c) for c in cuts(x, k)), abs=1e-6)


def test_many_counts_equal_the_full_table():
    """Halving gives what looking everywhere gives."""
    rnd = np.random.default_rng(1)
    x = np.unique(rnd.pareto(1.0, 700).cumsum().astype(np.int64) + 1)
    m = rnd.integers(1, 50, len(x))
    n, one, two = (np.r_[0.0, np.cumsum(v.astype(float))] for v in (m, m * x, m * x * x))
    best = np.r_[np.inf, two[1:] - one[1:] ** 2 / n[1:]]
    for k in range(2, 6):
        best = np.array([np.inf] * k + [min(
            best[i] + two[j] - two[i] - (one[j] - one[i]) ** 2 / (n[j] - n[i]) for i in range(k - 1, j)) for j in range(k, len(n))])
        starts = clu.borders(x, m, [k])[k]
        ends = [*starts[1:], len(x)]
        got = sum(two[b] - two[a] - (one[b] - one[a]) ** 2 / (n[b] - n[a]) for a, b in zip(starts, ends))
        assert got == pytest.approx(best[-1], rel=1e-9)


def silhouette(points, labels):
    values = []
    for i, (p, c) in enumerate(zip(points, labels)):
        own = [abs(p - q) for j, (q, d) in enumerate(zip(points, labels)) if d == c and j != i]
        others = [[abs(p - q) for q, d in zip(points, labels) if d == o] for o in set(labels) - {c}]
        if not own:
            values.append(0.0)
            continue
        a, b = sum(own) / len(own), min(sum(o) / len(o) for o in others)
        values.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return sum(values) / len(values)


def test_clusters(spark):
    rows = [(n,) for n in [1, 2, 3] * 5 + [100, 101] * 3 + [5000, 5001]]
    counts = spark.createDataFrame(rows, "url_count bigint")
    got = sorted(tuple(r)[1:] for r in clu.cluster_ranges(counts, k=3).collect())
    assert got == [(1, 3, 15), (100, 101, 6), (5000, 5001, 2)]


def test_clusters_and_their_choice_by_dataset(spark):
    rnd = random.Random(2)
    counts = {"a": [rnd.choice([1, 2, 3, 50, 52, 55, 900, 910, 20000]) for _ in range(60)], "b": [1, 1, 1, 2], "c": [7], "d": [None, 5, 5]}
    rows = [(d, f"x{i}", n) for d, v in counts.items() for i, n in enumerate(v)]
    df = spark.createDataFrame(rows, "dataset_name string, domain string, url_count bigint")
    ranges = {(r.cluster, r.min_count, r.max_count) for r in clu.cluster_ranges(df.where("dataset_name = 'a'"), k=4).collect()}
    assert ranges == {(0, 1, 3), (1, 50, 55), (2, 900, 910), (3, 20000, 20000)}
    labels = clu.cluster_histogram(df, range(2, 6), by=["dataset_name"]).collect()
    assert {r.dataset_name for r in labels} == {"a", "b"}
    got = clu.silhouettes(df, range(2, 6), by=["dataset_name"]).collect()
    for r in got:
        own = {x.x: x.cluster for x in labels if x.dataset_name == r.dataset_name and x.k == r.k}
        points = counts[r.dataset_name]
        assert r.silhouette == pytest.approx(silhouette(points, [own[p] for p in points]))
    for d in ("a", "b"):
        own = sorted((-r.silhouette, r.k, r.chosen) for r in got if r.dataset_name == d)
        assert [x[2] for x in own] == [True] + [False] * (len(own) - 1)
    assert clu.silhouettes(df.limit(0)).count() == 0
