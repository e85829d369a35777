import statistics

import pytest
from corpusprov.operators import concentration as conc
from corpusprov.operators import counts as cnt
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sample():
    # One domain holds a third of everything, most hold one URL.
    return [1] * 60 + [2] * 15 + [3] * 9 + [10, 11, 12, 100, 101, 250, 999, 1000, 1001, 2500]


@pytest.fixture(scope="module")
def counts(spark, sample):
    return spark.createDataFrame([(f"d{i}", n) for i, n in enumerate(sample)],
                                 "domain string, url_count bigint")


def gini_sorted(x):
    x, n, cum, total = sorted(x), len(x), 0, 0
    for v in x:
        cum += v
        total += cum
    return (n + 1 - 2 * total / cum) / n


def gini_trapezoid(x):
    x, t, area, cum = sorted(x), sum(x), 0.0, 0
    for v in x:
        area += (cum + cum + v) / t / 2 / len(x)
        cum += v
    return (0.5 - area) / 0.5


def test_gini(spark, counts, sample):
    got = conc.gini(counts).first().gini
    assert got == pytest.approx(gini_sorted(sample), abs=1e-12)
    assert got == pytest.approx(gini_trapezoid(sample), abs=1e-12)
    same = spark.createDataFrame([(5,)] * 7, "url_count bigint")
    assert conc.gini(same).first().gini == pytest.approx(0, abs=1e-12)
    one = spark.createDataFrame([(0,)] * 9 + [(4,)], "url_count bigint")
    assert conc.gini(one).first().gini == pytest.approx(0.9)


def test_lorenz_and_top_share(counts, sample):
    x, t = sorted(sample), sum(sample)
    cum, run = [], 0
    for v in x:
        run += v
        cum.append(run / t * 100)
    curve = {r.url_count: r for r in conc.lorenz_curve(counts, origin=True).collect()}
    assert (curve[0].pct_domains, curve[0].pct_urls) == (0, 0)
    for v in set(x):
        last = max(i for i, y in enumerate(x) if y == v)
        assert curve[v].pct_urls == pytest.approx(cum[last])
        assert curve[v].pct_domains == pytest.approx((last + 1) / len(x) * 100)
    row = conc.top_share_pct(counts).first()
    assert row.top_1_pct == pytest.approx(100 - cum[int(0.99 * len(x))])
    assert row.top_10_pct == pytest.approx(100 - cum[int(0.90 * len(x))])
    assert row.median_urls == x[len(x) // 2]


def test_buckets(spark, counts, sample):
    got = {r.bucket: r.pct_domains for r in conc.size_bucket_pct(counts).collect()}
    assert got["1"] == pytest.approx(100 * 60 / len(sample))
    assert got["1K-9.9K"] == pytest.approx(100 * 3 / len(sample))
    assert got["100K+"] == 0 and len(got) == 7
    edges = spark.createDataFrame([(0,), (1,), (10,), (11,), (1000,), (1001,)], "url_count bigint")
    cut = {r.url_count: r.b for r in edges.withColumn("b", conc.cut_bucket()).collect()}
    assert cut == {0: None, 1: "one", 10: "small", 11: "medium", 1000: "large", 1001: "very_large"}
    assert {r.bucket: r.n_domains for r in conc.cut_bucket_counts(edges).collect()} == {
        "one": 1, "small": 1, "medium": 1, "large": 1, "very_large": 1}


def test_log_histogram(spark, counts, sample):
    import numpy as np
    out = sorted(conc.log_histogram(counts).collect())
    edges = np.logspace(0, np.log10(max(sample)), 50)
    edges[-1] = max(sample)
    want, _ = np.histogram(sample, bins=edges)
    assert [r.n_domains for r in out] == want.tolist()
    ones = spark.createDataFrame([(1,), (1,)], "url_count bigint")
    assert sum(r.n_domains for r in conc.log_histogram(ones).collect()) == 2


def test_shares_and_tops(counts, sample):
    shares = [r.share for r in cnt.with_share(counts).collect()]
    assert sum(shares) == pytest.approx(1)
    top = cnt.top_domains(counts, 3).collect()
    assert [r.url_count for r in top] == [2500, 1001, 1000]
    assert top[0].pct_urls == pytest.approx(2500 / sum(sample) * 100)
    row = cnt.top_share(counts, 10).first()
    best = sorted(sample)[-10:]
    assert row.top_share == pytest.approx(sum(best) / sum(sample))
    assert row.median_count == statistics.median(best)
    row = cnt.top_vs_median(counts, 10).first()
    assert row.med_cnt == statistics.median(sample)
    assert row.ratio == pytest.approx(sum(best) / statistics.median(sample))


def test_summary_thresholds_and_stats(spark, counts, sample):
    row = conc.count_summary(counts).first()
    assert (row.n_domains, row.max_urls) == (len(sample), 2500)
    assert row.mean_urls == pytest.approx(statistics.mean(sample))
    got = {r.threshold: r.n_domains for r in cnt.threshold_counts(counts, [10, 1000]).collect()}
    assert got == {10: 10, 1000: 3}
    hosts = spark.createDataFrame(
        [("s1", "a", 1), ("s1", "b", 2), ("s1", "b", 10), ("s1", "c", 4), ("s2", "a", 7)],
        "dataset_name string, url_host_name string, url_count bigint")
    s1 = cnt.snapshot_stats(hosts).where("dataset_name = 's1'").first()
    assert (s1.total_hosts, s1.total_urls) == (3, 17)
    assert (s1.urls_25th, s1.median_urls, s1.urls_75th) == (1.75, 3.0, 5.5)


def test_unify_and_match(spark, rows):
    urls = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", None)],
                                 "dataset_name string, domain string")
    hosts = spark.createDataFrame([("c", "a", 2), ("c", "a", 3)],
                                  "dataset_name string, url_host_name string, url_count int")
    assert rows(cnt.unify_counts(urls, hosts)) == [("c", "a", 5), ("u", "a", 2), ("u", None, 1)]
    assert rows(cnt.unify_counts(None, hosts, merge=False)) == [("c", "a", 2), ("c", "a", 3)]
    row = cnt.match_fraction(hosts, F.col("url_host_name").like("%a%"), "url_count").first()
    assert (row.matching, row.total, row.ratio) == (5, 5, 1.0)


def test_totals_use_no_single_partition_of_rows(counts):
    plan = cnt.with_share(counts)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
