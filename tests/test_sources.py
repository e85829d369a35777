import gzip
import json
import lzma

import pytest
from corpusprov.functions import SuffixRules
from corpusprov.operators import manifest as man
from corpusprov.sources import (
    append_results, compact, csv_to_parquet, dataset_slice, extract_batch, extract_urls, find_rule, host_urls,
    list_files, read_corpus, read_datasets, read_results, read_xz_lines, rules_frame, sample_rows,
    scan_tables, tagged, url_columns, write_batches, write_csv,
    write_url_batch,
)
from corpusprov.sources.rules import all_rules
from corpusprov.streaming import ingest_counts, ingest_urls, running_counts

COMMON = SuffixRules.common()
URLS = [f"https://www.site{i}.co.uk/p{i}" for i in range(5)]


def ndjson(rows):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


def test_formats(spark, tmp_path):
    text = ndjson({"url": u, "n": i, "text": "é\n"} for i, u in enumerate(URLS))
    (tmp_path / "a.jsonl").write_text(text, encoding="utf-8")
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.jsonl.xz").write_bytes(lzma.compress(text.encode()))
    (tmp_path / "d.csv").write_text("url,n\n" + "".join(f"{u},{i}\n" for i, u in enumerate(URLS)))
    spark.createDataFrame([(u,) for u in URLS], "url string").write.parquet(str(tmp_path / "e.parquet"))
    for name in ("a.jsonl", "b.json.gz", "c.jsonl.xz", "d.csv", "e.parquet"):
        schema = None if name.endswith((".csv", ".parquet")) else "url string"
        df = read_corpus(spark, str(tmp_path / name), schema=schema)
        assert sorted(r.url for r in df.collect()) == URLS, name
    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "f.jsonl.zst").write_bytes(zstandard.compress(text.encode()))
    df = read_corpus(spark, str(tmp_path / "f.jsonl.zst"), schema="url string")
    assert sorted(r.url for r in df.collect()) == URLS


def test_csv_fields_go_by_name_and_may_hold_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,url\n1,"two\nlines, ""quoted""",u1\n2,x,u2\n')
    df = read_corpus(spark, str(tmp_path / "a.csv"), schema="url string, id int")
    assert sorted(map(tuple, df.collect())) == [("u1", 1), ("u2", 2)]


def test_from_files_to_url_table(spark, tmp_path):
    rule = find_rule("allenai/madlad-400", "clean")
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    folder = tmp_path / "in" / "data-v1p5" / "en"
    folder.mkdir(parents=True)
    for i in range(5):
        for kind in ("clean", "noisy"):
            text = ndjson([{"url": URLS[i], "text": "x"}, {"text": "no url"}])
            (folder / f"{kind}_{i}.jsonl.gz").write_bytes(gzip.compress(text.encode()))
    files = list_files(spark, root).where(
        man.rule_filter("path", rule.prefixes, rule.suffix, rule.excludes))
    files = files.selectExpr(f"'{rule.output}' AS dataset_name", "path", "size")
    assert files.count() == 5
    store = str(tmp_path / "batches")
    write_batches(man.size_batches(files, ["dataset_name"], 200), store, ["dataset_name"])
    batched = spark.read.parquet(store)
    numbers = sorted(r.batch for r in batched.select("batch").distinct().collect())
    assert numbers[0] == 1 and len(numbers) > 1
    for n in numbers:
        assert extract_batch(spark, batched, n, rule, root, target, COMMON)
    assert not extract_batch(spark, batched, 99, rule, root, target, COMMON)
    got = read_datasets(spark, target, ["madlad-400_urls_clean"])
    assert sorted(r.url for r in got.collect()) == URLS


def test_xz_whole_file_in_pieces_and_by_path(spark, tmp_path, monkeypatch):
    lines = [f"{i} " + "ü" * (i % 50) for i in range(25_000)]
    for k in range(2):
        (tmp_path / f"{k}.xz").write_bytes(lzma.compress("\n".join(lines).encode()))
    for inline in (10**9, 0):
        got = read_xz_lines(spark, [str(tmp_path)], inline_bytes=inline)
        assert sorted(r.value for r in got.collect()) == sorted(lines * 2)


def test_what_cannot_be_read_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        read_corpus(spark, "x.jsonl.xz")
    with pytest.raises(ValueError, match="cannot read"):
        read_corpus(spark, "x.csv.xz")
    with pytest.raises(ValueError, match="several formats"):
        read_corpus(spark, ["a.parquet", "b.csv"])


def test_every_rule_reads_its_field(spark, tmp_path):
    assert len(all_rules()) == 53
    assert find_rule("allenai/c4", "multilingual").excludes == ("-validation",)
    assert find_rule("infi-mm/infimm-webmath-40b").prefixes == ("part-",)
    with pytest.raises(KeyError):
        find_rule("allenai/c4")
    url = URLS[0]
    for i, rule in enumerate(all_rules()):
        kind, _, field = rule.url_field.partition(":")
        if kind == "dict" and field:
            raw = {field: f"{{'a': 1, 'url': '{url}'}}"}
        elif kind == "json" and field:
            raw = {field: json.dumps({"url": url})}
        else:
            raw = url
            for name in reversed(rule.url_field.split(".")):
                raw = {name.strip("`"): raw}
        path = tmp_path / f"{i}.jsonl"
        path.write_text(ndjson([raw, {"other": 1}]))
        df = read_corpus(spark, str(path), ".jsonl", rule.read_schema())
        assert [tuple(r) for r in extract_urls(df, rule, COMMON).collect()] == [(url, "site0.co.uk")], rule
    frame = {r.output: r.folder for r in rules_frame(spark).collect()}
    assert frame["c4_urls_multilingual"] == "allenai_c4_multilingual"
    assert frame["dclm-baseline-1.0-parquet_urls"] == "mlfoundations_dclm_baseline_1_0_parquet_default"


def test_dict_text_without_a_url(spark):
    raw = spark.createDataFrame([("{'a': 1}",)], "source_other string")
    rule = find_rule("zyphra/zyda")
    assert extract_urls(raw, rule, COMMON).count() == 0
    assert [tuple(r) for r in extract_urls(raw, rule, COMMON, strict_parity=True).collect()] == [("", ".")]


def test_manifest_and_selected_files(spark, tmp_path, rows):
    for name in ("data/x/a.parquet", "data/b.txt", "other/c.parquet"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    files = list_files(spark, str(tmp_path))
    assert rows(files) == [("data/b.txt", 5), ("data/x/a.parquet", 5), ("other/c.parquet", 5)]
    rule = find_rule("huggingfacefw/fineweb")
    kept = files.where(man.rule_filter("path", rule.prefixes, rule.suffix, rule.excludes))
    assert rows(kept) == [("data/x/a.parquet", 5)]


def test_dataset_tables(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    a = spark.createDataFrame([("u1", "d1"), ("u2", "d2")], "url string, domain string")
    for name in ("a", "b"):
        write_url_batch(a, root, name, 1)
    write_url_batch(a.limit(1), root, "b", 2)
    write_url_batch(a, root, "b", 1)
    df = read_datasets(spark, root, ["b"])
    assert df.count() == 3
    assert all("dataset_name=b" in f for f in df.inputFiles())
    with pytest.raises(ValueError, match="nowhere"):
        read_datasets(spark, root, ["b", "nowhere"])
    both = tagged({"x": a, "y": a})
    assert rows(dataset_slice(both, ["y"])) == [("u1", "d1", "y"), ("u2", "d2", "y")]
    assert sample_rows(both, 2, ["dataset_name", "url"]).count() == 2


def test_host_urls(spark, rows):
    index = spark.createDataFrame(
        [("C1", "h.com", u) for u in ("https://h.com", "https://h.com/", "https://h.com/a",
                                      "https://h.com/robots.txt")]
        + [("C2", "h.com", "https://h.com/b"), ("C1", "g.com", "https://g.com/c")],
        "crawl string, url_host_name string, url string")
    assert rows(host_urls(index, "C1", "h.com")) == [("https://h.com/a",)]


def test_url_columns(spark):
    df = spark.createDataFrame([("see www.abc.com/x", "none", 1), ("y", "no", 2)],
                               "website string, source string, path_id int")
    got = {r.column_name: r.has_urls for r in url_columns(df, "t").collect()}
    assert got == {"website": True, "source": False, "path_id": False}

    def broken():
        raise OSError("gone")

    plain = spark.createDataFrame([("a.b.cc",)], "text string")
    out = scan_tables(spark, {"t": lambda: df, "broken": broken, "plain": lambda: plain})
    assert {r.table_name: (r.has_urls, r.error) for r in out.collect()} == {
        "t": (True, None), "broken": (False, "OSError"), "plain": (False, None)}


def test_sinks(spark, tmp_path):
    df = spark.range(20).selectExpr("concat('k', id) AS k", "id AS v")
    many, one, csv, back = (str(tmp_path / n) for n in ("many", "one", "csv", "back"))
    df.repartition(5).write.parquet(many)
    compact(spark, many, one, 2)
    assert len(list((tmp_path / "one").glob("*.zstd.parquet"))) == 2
    assert spark.read.parquet(one).count() == 20
    write_csv(df, csv)
    csv_to_parquet(spark, csv, back, "k string, v bigint")
    assert sorted(map(tuple, spark.read.parquet(back).collect())) == sorted(map(tuple, df.collect()))
    store, schema = str(tmp_path / "store"), "k string, v bigint, computed_at timestamp"
    assert read_results(spark, store, schema).count() == 0
    append_results(df.where("v < 3"), store, "k", schema)
    append_results(df.where("v < 5"), store, "k", schema)
    assert read_results(spark, store, schema).count() == 5


def test_stream_takes_each_file_once(spark, tmp_path, rows):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    counts, cp2 = str(tmp_path / "counts"), str(tmp_path / "cp2")
    source.mkdir()

    def add(name, urls):
        (source / name).write_text(ndjson({"meta": {"url": u}} for u in urls))

    def run():
        args = dict(schema="meta struct<url: string>", dataset_name="ds", suffixes=COMMON, url_sql="meta.url",
                    fmt="json", max_bytes=1)
        ingest_urls(spark, str(source), out, cp, **args)
        ingest_counts(spark, str(source), counts, cp2, **args)

    add("a.jsonl", URLS[:2])
    add("b.jsonl", [URLS[0], None])
    run()
    assert read_datasets(spark, out, ["ds"]).count() == 3
    run()
    assert read_datasets(spark, out, ["ds"]).count() == 3
    add("c.jsonl", URLS)
    run()
    assert read_datasets(spark, out, ["ds"]).count() == 8
    assert rows(running_counts(spark, counts)) == [
        ("ds", "site0.co.uk", 3), ("ds", "site1.co.uk", 2), ("ds", "site2.co.uk", 1),
        ("ds", "site3.co.uk", 1), ("ds", "site4.co.uk", 1)]


def test_urls_below_the_tenth_row_count(spark):
    rows = [("plain",)] * 10 + [("https://a.example.com/",)]
    df = spark.createDataFrame(rows, "page_url string").coalesce(1)
    assert url_columns(df, "t").first().has_urls
    assert not url_columns(df, "t", n=10).first().has_urls


def test_compacting_keeps_datasets_and_writers_stay_apart(spark, tmp_path):
    from corpusprov.sources.sinks import compact
    urls = spark.createDataFrame([("https://a.com/", "a.com")], "url string, domain string")
    root, small = str(tmp_path / "urls"), str(tmp_path / "small")
    for writer in ("one", "two"):
        write_url_batch(urls, root, "d", 1, writer=writer)
    write_url_batch(urls, root, "e", 1)
    compact(spark, root, small, 1)
    got = spark.read.parquet(small).groupBy("dataset_name").count().collect()
    assert {r["dataset_name"]: r["count"] for r in got} == {"d": 2, "e": 1}


def test_files_are_relative_to_the_root_itself(spark, tmp_path):
    from corpusprov.sources.readers import list_files
    root = tmp_path / "b"
    inner = root / "x" / "b"
    inner.mkdir(parents=True)
    (inner / "f").write_text("1")
    assert [r.path for r in list_files(spark, str(root)).collect()] == ["x/b/f"]
