"""State, sketches and results that grow by increments."""

import json

import pytest

from corpusprov.functions import SuffixRules
from corpusprov.operators import counts as cnt
from corpusprov.operators import divergence as div
from corpusprov.sources import append_results, current_results
from corpusprov.streaming import current_totals, ingest_totals


def test_totals_of_a_stream_go_on_after_a_restart(spark, tmp_path, rows):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def put(name, hosts):
        (source / name).write_text("".join(json.dumps({"url": h and f"http://www.{h}/x"}) + "\n" for h in hosts))

    def run():
        ingest_totals(spark, str(source), out, cp, "url string", "ds", SuffixRules.common(), fmt="json", max_bytes=1)
        return rows(current_totals(spark, out).select("domain", "url_count"))

    put("a.json", ["a.com", "a.com", "b.com", None])
    put("b.json", ["a.com"])
    assert run() == [("a.com", 3), ("b.com", 1)]
    assert run() == [("a.com", 3), ("b.com", 1)]  # no new file, no double count
    put("c.json", ["b.com", "c.org"])
    assert run() == [("a.com", 3), ("b.com", 2), ("c.org", 1)]
    # a batch holds only the totals that it changed
    written = spark.read.parquet(out)
    last = written.where(written.batch == written.agg({"batch": "max"}).first()[0])
    assert rows(last.select("domain")) == [("b.com",), ("c.org",)]


def test_unions_of_stored_sketches(spark, tmp_path):
    hosts = spark.range(40_000).selectExpr(
        "concat('h', id % 30000) AS url_host_name", "concat('s', cast(id / 10000 as int)) AS dataset_name")
    path = str(tmp_path / "sketches")
    for name in ("s0", "s1", "s2", "s3"):  # each snapshot alone
        cnt.distinct_sketches(hosts.where(f"dataset_name = '{name}'"), ["dataset_name"]).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    for names, exact in ((["s0"], 10_000), (["s0", "s3"], 10_000), (["s0", "s1"], 20_000), (["s0", "s1", "s2", "s3"], 30_000)):
        got = cnt.distinct_of_sketches(stored.where(stored.dataset_name.isin(names))).first()
        assert got.low <= exact <= got.high and abs(got.estimate - exact) <= 3 * cnt.SKETCH_ERROR * exact
    each = cnt.distinct_of_sketches(stored, ["dataset_name"]).collect()
    assert len(each) == 4 and all(r.low <= 10_000 <= r.high for r in each)
    few = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None)], "dataset_name string, url_host_name string")
    assert cnt.distinct_of_sketches(cnt.distinct_sketches(few, ["dataset_name"])).first().estimate == 1


def test_two_runs_at_once_leave_one_row_a_pair(spark, tmp_path):
    schema, path = div.RESULT_SCHEMA, str(tmp_path / "results")
    rows = spark.createDataFrame([("p1", "k", 0.5), ("p2", "k", 1.5)], "pair_id string, pair_key string, kl_divergence double")
    append_results(rows, path, "pair_id", schema)
    first = {r.pair_id: r.computed_at for r in current_results(spark, path, "pair_id", schema).collect()}
    # what a second run writes that read the store before the first one had written
    rows.selectExpr("*", "current_timestamp() AS computed_at").write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 4
    got = current_results(spark, path, "pair_id", schema).collect()
    assert {r.pair_id: r.computed_at for r in got} == first and len(got) == 2
    assert current_results(spark, str(tmp_path / "none"), "pair_id", schema).count() == 0


@pytest.mark.parametrize("batch", [1, 2])
def test_batch_exists(spark, rows, batch):
    from corpusprov.operators.manifest import batch_exists

    batched = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "dataset_name string, batch int")
    assert rows(batch_exists(batched, ["dataset_name"], batch)) == [("a", True), ("b", batch == 1)]
