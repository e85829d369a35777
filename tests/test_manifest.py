import random

import pytest
from corpusprov.operators import manifest as man
from corpusprov.operators.ordering import number_rows, top_n_per_group
from corpusprov.sources import write_batches
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def fill(files, target):
    """Batches as the rule says it: one file after the other."""
    out, batch, used, empty = {}, 1, 0, True
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if used + size > target and not empty:
            batch, used = batch + 1, 0
        out[path], used, empty = batch, used + size, False
    return out


def batches(spark, files, target):
    df = spark.createDataFrame([("d", p, s) for p, s in files],
                               "dataset_name string, path string, size bigint")
    got = man.size_batches(df, ["dataset_name"], target).collect()
    assert len(got) == len(files)
    return {r.path: r.batch for r in got}


def test_small_case(spark):
    files = [("a", 5), ("b", 4), ("c", 3), ("d", 2)]
    assert batches(spark, files, 7) == {"a": 1, "b": 2, "c": 2, "d": 3}
    assert batches(spark, [("a", 50), ("b", 1)], 7) == {"a": 1, "b": 2}


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.sampled_from([0, 1, 2, 3, 5, 8, 13, 40]), min_size=1, max_size=60),
       target=st.integers(min_value=1, max_value=30))
def test_many_equal_sizes(spark, sizes, target):
    files = [(f"f{i:03d}", s) for i, s in enumerate(sizes)]
    assert batches(spark, files, target) == fill(files, target)


def test_batches_hold_the_target(spark):
    rnd = random.Random(3)
    rows = [(f"d{i % 3 and 1}", f"p{i}", rnd.choice([7, 7, 7, rnd.randrange(1, 60)]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "dataset_name string, path string, size bigint")
    out = man.size_batches(df, ["dataset_name"], 100)
    stats = man.batch_stats(out, ["dataset_name"])
    assert stats.where("gb * 1e9 > 100.5 AND n_files > 1").count() == 0
    assert out.count() == 400
    for d in ("d0", "d1"):
        want = fill([(p, s) for ds, p, s in rows if ds == d], 100)
        assert {r.path: r.batch for r in out.where(F.col("dataset_name") == d).collect()} == want
    totals = {r.dataset_name: r for r in man.batch_totals(out, ["dataset_name"]).collect()}
    assert totals["d1"].total_gb * 1e9 == pytest.approx(sum(s for d, _, s in rows if d == "d1"))


def test_row_numbers_in_a_hot_group(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", f"{rnd.randrange(10**9):09d}-{i}") for i in range(3000)]
    rows += [(None, "x"), (None, "y")]
    got = number_rows(spark.createDataFrame(rows, "g string, k string"), ["g"], ["k"]).collect()
    want = {}
    for g in {g for g, _ in rows}:
        for n, k in enumerate(sorted(k for h, k in rows if h == g), 1):
            want[(g, k)] = n
    assert {(r.g, r.k): r.row_number for r in got} == want


def test_chunks(spark):
    df = spark.createDataFrame([("d", f"p{i:04d}") for i in range(250)], "d string, path string")
    out = man.chunk_lines(df, ["d"], ["path"])
    assert {r.batch: r["count"] for r in out.groupBy("batch").count().collect()} == {
        1: 100, 2: 100, 3: 50}


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_per_group(spark, n):
    rows = [("hot" if i % 4 else "cold", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, x int")
    got = top_n_per_group(df, ["g"], [F.desc("x")], n)
    want = {g: sorted((x for h, x in rows if h == g), reverse=True)[:n] for g in ("hot", "cold")}
    assert {g: sorted((r.x for r in got.collect() if r.g == g), reverse=True)
            for g in want} == want


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id AS x")
    plan = top_n_per_group(df, ["g"], [F.desc("x")], 3)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.index("Exchange") < text.index("Partial"), text


def test_rules_and_paths(spark):
    paths = ["part-1.parquet", "art-2.parquet", "part-3.json", "part-valid.parquet"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = df.where(man.rule_filter("path", "part-", ".parquet", ["valid"])).collect()
    assert [r.path for r in kept] == ["part-1.parquet"]
    lines = spark.createDataFrame([(" a/c4/x.gz ",), ("",), ("# c",), ("a/b/y.gz",)], "value string")
    assert [tuple(r) for r in man.path_lines(lines, pattern=man.PATH_MARKS).collect()] == [
        ("a/c4/x.gz", "x.gz")]
    assert man.path_lines(lines).count() == 2


def test_work_tracking(spark, rows):
    batched = spark.createDataFrame([("d", "a", 1), ("d", "b", 2), ("e", "c", 1)],
                                    "dataset_name string, path string, batch int")
    done = spark.createDataFrame([("d", 1), ("e", 1)], "dataset_name string, batch int")
    assert rows(man.next_batch(batched, done, ["dataset_name"])) == [("d", 2)]
    assert man.requested_batch(batched, 2).count() == 1
    assert not man.has_batches(man.requested_batch(batched, 9))


def test_files_of_unknown_size_are_kept(spark):
    from corpusprov.operators.manifest import size_batches
    files = spark.createDataFrame([("g", "a", 5), ("g", "b", None), ("g", "c", 4)], "g string, path string, size bigint")
    got = {r.path: r.batch for r in size_batches(files, ["g"], target=7).collect()}
    assert got == {"a": 1, "b": 0, "c": 2}


def test_files_of_each_rule(spark):
    files = spark.createDataFrame(
        [("data/a.jsonl.gz", 1), ("data/b.x/c.jsonl.gz", 2), ("data/noisy_d.jsonl.gz", 4),
         ("other/e.gz", 8), ("data/plain", 16), ("data/f.jsonl.gz", None)], "path string, size bigint")
    rules = spark.createDataFrame(
        [("lines", ["data/"], ".jsonl.gz", ["noisy_"]), ("packed", [], ".gz", []), ("none", ["x/"], ".gz", [])],
        "output string, prefixes array<string>, suffix string, excludes array<string>")
    got = {r.output: (r.n_files, r.bytes) for r in man.files_by_rule(files, rules).collect()}
    assert got == {"lines": (3, 3), "packed": (5, 15), "none": (0, 0)}


def test_a_batch_is_one_file_however_many_tasks_write(spark, tmp_path):
    path = str(tmp_path / "batches")
    batched = spark.range(400).repartition(8).selectExpr(
        "if(id % 7 = 0, null, concat('d', id % 2)) dataset_name", "concat('p', id) path", "id size", "int(id % 5) batch")
    write_batches(batched, path, ["dataset_name"])
    back = spark.read.schema(batched.schema).parquet(path)
    assert sorted(back.select(*batched.columns).collect(), key=repr) == sorted(batched.collect(), key=repr)
    assert len(back.inputFiles()) == back.select("dataset_name", "batch").distinct().count() == 15
