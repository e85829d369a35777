import math
import random
from collections import defaultdict

import pytest
from corpusprov.operators import divergence as div

SCHEMA = "dataset_name string, domain string, url_count bigint"


def brute(p_rows, q_rows, merge):
    """Sum of p * ln(p / q) as written, with each row of P meeting each row of Q."""
    def side(rows):
        rows = [(d, n) for d, n in rows if n > 0]
        if merge:
            sums = defaultdict(int)
            for d, n in rows:
                sums[d] += n
            rows = list(sums.items())
        total = sum(n for _, n in rows)
        return [(d, n / total) for d, n in rows]
    p, q = side(p_rows), side(q_rows)
    if not p:
        return None
    out = 0.0
    for d, pp in p:
        hits = [qq for e, qq in q if e == d and d is not None] or [1e-12]
        out += sum(pp * math.log(pp / qq) for qq in hits)
    return out


def run(spark, p_rows, q_rows, merge=True):
    p = spark.createDataFrame(p_rows, "domain string, url_count bigint")
    q = spark.createDataFrame(q_rows, "domain string, url_count bigint")
    return div.kl_divergence(p, q, merge=merge).first().kl_divergence


CASES = {
    "same": ([("a", 3), ("b", 1)], [("a", 3), ("b", 1)]),
    "only in p": ([("a", 1), ("b", 1)], [("a", 5)]),
    "only in q": ([("a", 1)], [("a", 1), ("b", 9)]),
    "null domain": ([(None, 2), ("a", 2)], [(None, 2), ("a", 2)]),
    "zero counts": ([("a", 0), ("b", 4)], [("a", 3), ("b", 0)]),
    "empty q": ([("a", 1), ("b", 3)], []),
    "empty p": ([], [("a", 1)]),
    "repeats": ([("a", 1), ("a", 2), ("b", 5)], [("a", 4), ("a", 6), ("b", 1)]),
}


@pytest.mark.parametrize("merge", [True, False])
@pytest.mark.parametrize("name", CASES)
def test_hand_cases(spark, name, merge):
    p, q = CASES[name]
    want = brute(p, q, merge)
    got = run(spark, p, q, merge)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-9)


def test_merging_matters_for_repeats(spark):
    p, q = CASES["repeats"]
    assert run(spark, p, q, True) != pytest.approx(run(spark, p, q, False))


def test_all_pairs_equals_single_pairs(spark):
    rnd = random.Random(1)
    rows = [(ds, f"d{rnd.randrange(30)}", rnd.randrange(1, 1000))
            for ds in ("a", "b", "c", "CC-MAIN-2024-10_urls") for _ in range(40)]
    counts = spark.createDataFrame(rows, SCHEMA)
    pairs = [(["own/a"], ["own/b"]), (["own/a", "own/CC-MAIN-2024-10_urls"], ["own/c"]),
             (["own/b", "own/c"], ["own/a"])]
    for merge in (True, False):
        out = div.kl_all_pairs(counts, div.pairs_frame(spark, pairs), merge, check_names=True)
        got = {r.pair_key: r.kl_divergence for r in out.collect()}
        assert set(got) == {"a_to_b", "2_sources_a_to_c", "2_sources_b_to_a"}
        for (p, q), key in zip(pairs, ["a_to_b", "2_sources_a_to_c", "2_sources_b_to_a"]):
            def pick(names):
                short = {n.split("/")[-1] for n in names}
                return [(d, n) for ds, d, n in rows if ds in short]
            assert got[key] == pytest.approx(brute(pick(p), pick(q), merge), abs=1e-9)


def test_unknown_dataset_is_an_error(spark):
    counts = spark.createDataFrame([("a", "x", 1)], SCHEMA)
    pairs = div.pairs_frame(spark, [("a", "nowhere")])
    with pytest.raises(ValueError, match="nowhere"):
        div.kl_all_pairs(counts, pairs)
    # Without the check the pair is there, with P's mass against epsilon.
    unchecked = div.kl_all_pairs(counts, pairs, check_names=False)
    assert unchecked.first().kl_divergence == pytest.approx(-math.log(1e-12))


def test_results_are_kept_and_only_new_pairs_computed(spark, tmp_path):
    counts = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("b", "y", 2)], SCHEMA)
    path = str(tmp_path / "results")
    div.update_results(counts, div.pairs_frame(spark, [("a", "b")]), path)
    first = spark.read.parquet(path).first()
    div.update_results(counts, div.pairs_frame(spark, [("a", "b"), ("b", "a")]), path)
    stored = {r.pair_key: r for r in spark.read.parquet(path).collect()}
    assert set(stored) == {"a_to_b", "b_to_a"}
    assert stored["a_to_b"].computed_at == first.computed_at
    assert div.datasets_of([("o/a", ["o/b", "c"])]) == ["a", "b", "c"]


def test_hot_domain_is_combined_before_the_shuffle(spark):
    counts = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], SCHEMA)
    out = div.kl_all_pairs(counts, div.pairs_frame(spark, [("a", "b")]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("merge", [True, False])
def test_counts_are_shuffled_once_on_the_domain(spark, merge):
    counts = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], SCHEMA)
    out = div.kl_all_pairs(counts, div.pairs_frame(spark, [("a", "b"), ("b", "a")]), merge)
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(domain" in x]
    assert len(exchanges) == 1 and "hashpartitioning(pair#" in plan and ", domain#" not in "".join(
        x for x in plan.splitlines() if "hashpartitioning(pair" in x)


def test_names_are_looked_for_where_they_are_known(spark):
    counts = spark.createDataFrame([("a", "x", 1)], SCHEMA)
    known = spark.createDataFrame([("a", 1), ("b", 2)], "dataset_name string, other int")
    pairs = div.pairs_frame(spark, [("a", "b")])
    assert div.kl_all_pairs(counts, pairs, known=known).count() == 1
    with pytest.raises(ValueError, match="b"):
        div.kl_all_pairs(counts, pairs, known=known.where("other = 1"))


def test_pairs_that_share_a_label_stay_apart(spark, tmp_path):
    rows = [("CC_MAIN_1", "x", 1), ("CC_MAIN_2", "y", 1), ("CC_MAIN_3", "x", 3), ("CC_MAIN_4", "y", 5), ("c", "x", 1)]
    counts = spark.createDataFrame(rows, SCHEMA)
    pairs = div.pairs_frame(spark, [(["CC_MAIN_1", "CC_MAIN_2"], ["c"]), (["CC_MAIN_3", "CC_MAIN_4"], ["c"])])
    got = div.kl_all_pairs(counts, pairs).collect()
    assert len(got) == 2 and len({r.pair_key for r in got}) == 1 and len({r.pair_id for r in got}) == 2
    wanted = [brute([("x", a), ("y", b)], [("x", 1)], True) for a, b in ((1, 1), (3, 5))]
    assert sorted(r.kl_divergence for r in got) == pytest.approx(sorted(wanted))
    path = str(tmp_path / "results")
    div.update_results(counts, pairs.limit(1), path)
    div.update_results(counts, pairs, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="nowhere"):
        div.update_results(counts, div.pairs_frame(spark, [("c", "nowhere")]), path)
