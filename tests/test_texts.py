import datetime
import math

import random

import pandas as pd
import pytest
from corpusprov.functions import clean_name, output_name, path_facets, snapshot_monday
from corpusprov.functions.names import is_crawl
from corpusprov.operators import facets as fac
from corpusprov.operators import labels as lab
from corpusprov.operators import lineage as lin
from corpusprov.operators import mentions as men
from corpusprov.operators import sampling as sam
from corpusprov.operators.timeline import snapshot_timeline, snapshots_between
from pyspark.sql import functions as F

DOCS = [
    (1, "Built from C4 and the C4 news part"), (2, "nothing"), (3, "abc4d ROOTS ÀÉ text"),
    (4, "uses Common Crawl, roots"), (5, ""), (6, None), (7, "c4\nfineweb-edu. fineweb"),
]
TERMS = [("o/c4", "c4"), ("o/news", "C4 News"), ("o/roots", "roots"), ("o/àé", "àé"),
         ("o/edu", "FineWeb-Edu"), ("o/fw", "fineweb"), ("x/c4", "c4"), ("o/none", "zzz")]


def brute_mentions():
    return sorted({(i, t) for i, text in DOCS for t, name in TERMS
                   if text is not None and name.lower() in text.lower()})


@pytest.mark.parametrize("small", [True, False])
def test_mentions(spark, rows, monkeypatch, small):
    docs = spark.createDataFrame(DOCS, "id int, readme string")
    terms = spark.createDataFrame([*TERMS, ("o/empty", ""), ("o/null", None)], "tid string, name string")
    if not small:
        monkeypatch.setattr(men, "BROADCAST_BYTES", 0)
    got = men.find_mentions(docs, terms, "id", "readme", "tid", "name")
    assert rows(got) == brute_mentions()
    assert "Arrow" not in got._jdf.queryExecution().toString() and "Python" not in got._jdf.queryExecution().toString()


ODD = [(1, "has alpha"), (1, "has beta"), (1, "has beta"), (None, "alpha and beta"), (None, None), (None, "ALPHA"), (2, "")]


@pytest.mark.parametrize("n", [1, 2, 200_000])
def test_mentions_of_repeated_and_null_ids(spark, n):
    """Each row has its own list, however many terms there are."""
    docs = spark.createDataFrame(ODD, "id int, t string")
    names = ["alpha", "beta"][:n]
    terms = spark.createDataFrame([(x, x) for x in names], "tid string, name string").unionByName(
        spark.range(max(0, n - 2)).selectExpr("concat('t', id) as tid", "concat('no such name ', id) as name"))
    got = men.mention_lists(docs, terms, "id", "t", "tid", "name").collect()
    want = [(i, [x for x in names if t and x in t.lower()]) for i, t in ODD]
    assert sorted(((r.id, r.mentioned) for r in got), key=repr) == sorted(want, key=repr)


def test_mentions_equal_brute_force(spark, monkeypatch):
    """Terms of all lengths, over borders of chunks, with pieces that most texts have."""
    monkeypatch.setattr(men, "CHUNK", 50)
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("abÄ 😀\n") for _ in range(rnd.randrange(300)))) for i in range(60)]
    texts += [(i, "a common line of boilerplate " * 20 + t) for i, t in texts[:40]]
    starts = [(rnd.choice(texts)[1], rnd.randrange(250), rnd.randrange(1, 40)) for _ in range(150)]
    names = {t[a:a + n] for t, a, n in starts} | {"a common line of boilerplate x", "a common line", "q" * 30}
    terms = sorted(enumerate(sorted(names - {""})))
    got = men.find_mentions(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(terms, "tid int, name string"),
                            "id", "t", "tid", "name")
    want = [(i, k) for i, t in texts for k, name in terms if name.lower() in t.lower()]
    found = sorted(map(tuple, got.collect()))
    assert not {(terms[k], i) for i, k in set(want) ^ set(found)} and len(found) == len(want)


def test_mention_lists_with_the_crawl(spark):
    docs = spark.createDataFrame(DOCS, "id int, readme string")
    terms = men.with_crawl_terms(spark.createDataFrame(TERMS, "tid string, name string"), "tid", "name")
    got = {r.id: r.mentioned for r in
           men.mention_lists(docs, terms, "id", "readme", "tid", "name").collect()}
    assert got[4] == ["commoncrawl", "o/roots"]
    assert got[2] == [] and got[6] == []
    assert got[7] == ["o/c4", "o/edu", "o/fw", "x/c4"]
    none = men.find_mentions(docs, spark.createDataFrame([], "tid string, name string"),
                             "id", "readme", "tid", "name")
    assert none.columns == ["id", "term_id"] and none.count() == 0


def test_mentions_depth1(spark, rows):
    found = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("x", "x"), ("d", "x")],
                                  "id string, term_id string")
    wanted = spark.createDataFrame([("x",)], "id string")
    crawl = spark.createDataFrame([("b",)], "id string")
    assert rows(men.mentions_depth1(found, wanted, [crawl])) == [("a",), ("d",)]


def test_labels(spark):
    text = [
        (1, 'x\n```json\n{"url": "u", "is_news": true, "reason": "r"}\n```\n'),
        (2, "no fence"), (3, "```json\n{bad\n```"), (4, '```json\n{\n "is_news": false\n}\n```'), (5, None),
    ]
    df = spark.createDataFrame(text, "i int, t string").select("i", lab.parse_response("t").alias("r"))
    got = {r.i: r.r and r.r.is_news for r in df.collect()}
    assert got == {1: True, 2: None, 3: None, 4: False, 5: None}
    y = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0)], "y int, a int, z int")
    m = {r.model: r for r in lab.label_metrics(y, "y", {"a": "a", "z": "z"}).collect()}
    assert (m["a"].accuracy, m["a"].precision, m["a"].recall, m["a"].f1) == (0.5, 0.5, 0.5, 0.5)
    assert (m["z"].accuracy, m["z"].precision, m["z"].recall, m["z"].f1) == (0.5, 0, 0, 0)


def test_path_facets(spark):
    urls = {
        "https://n.com/2019/03/04/arts/x.html": (2019, "arts"),
        "https://n.com/2019/03/04": (None, None), "https://n.com/a/b/c/arts": (None, None),
        "https://n.com/2019x/03/04/arts": (None, None), "https://n.com/2019/1/2/": (2019, ""),
        "": (None, None), None: (None, None), "https://n.com/99999999999999999999/1/2/a": (None, None),
    }
    df = path_facets(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert {r.url: (r.year, r.section) for r in df.collect()} == urls


def test_sections(spark, rows):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", None), ("a", "y"), ("b", "x"), ("b", "z")],
        "dataset_name string, section string")
    pct = fac.section_pct(df)
    assert {(r.dataset_name, r.section): r.percentage for r in pct.collect()} == {
        ("a", "x"): 0.5, ("a", "y"): 0.25, ("b", "x"): 0.5, ("b", "z"): 0.5}
    assert rows(fac.common_sections(pct, "a", "b")) == [("x",)]
    assert fac.common_section_delta(pct, "a", "b").first().pct_diff == 0
    a, b = (df.where(F.col("dataset_name") == n) for n in "ab")
    delta = {r.section: r.delta for r in fac.section_share_delta(a, b).collect()}
    assert delta == {"x": pytest.approx(0.5 - 2 / 3), "y": pytest.approx(-1 / 3), "z": 0.5}


def test_year_density_is_a_density(spark):
    data = [("a", y) for y in (1990, 1990, 1995, 2001)] + [("b", y) for y in (2000, 2004)] + [("a", 1900)]
    df = spark.createDataFrame(data, "dataset_name string, year int")
    out = fac.year_density(df).toPandas()
    years = [y for d, y in data if d == "a" and y > 1960]
    n, mean = len(years), sum(years) / len(years)
    h = math.sqrt(sum((y - mean) ** 2 for y in years) / (n - 1)) * n ** -0.2
    row = out[(out.dataset_name == "a") & (out.point == 120)].iloc[0]
    want = sum(math.exp(-0.5 * ((row.year - y) / h) ** 2) for y in years) / (
        n * h * math.sqrt(2 * math.pi)) * n / 6
    assert row.density == pytest.approx(want)
    area = 0
    for _, g in out.groupby("dataset_name"):
        g = g.sort_values("year")
        step = g.year.iloc[1] - g.year.iloc[0]
        area += g.density.sum() * step
    assert area == pytest.approx(1, abs=0.02)


def test_snapshot_mondays(spark):
    rows = [(y, w) for y in range(2013, 2025) for w in range(1, 53)]
    df = spark.createDataFrame(rows, "y int, w int").withColumn("d", snapshot_monday("y", "w"))
    for r in df.collect():
        assert r.d == datetime.datetime.strptime(f"{r.y} {r.w:02d} 1", "%Y %W %w").date()


def test_snapshot_names(spark):
    names = ["CC-MAIN-2024-10_urls", "cc_main_2013_20", "other"]
    df = snapshot_timeline(spark.createDataFrame([(n,) for n in names], "dataset_name string"))
    got = {r.dataset_name: (r.year, r.week) for r in df.collect()}
    assert got == {names[0]: (2024, 10), names[1]: (2013, 20), "other": (None, None)}
    between = snapshots_between(df, (2013, 20), (2024, 9))
    assert [r.dataset_name for r in between.collect()] == [names[1]]
    flags = spark.createDataFrame([(n,) for n in names], "n string").select(is_crawl("n").alias("c"))
    assert [r.c for r in flags.collect()] == [True, False, False]


def test_names(spark):
    row = spark.createDataFrame([("a/b-c.d", "default", "x_y")], "d string, v string, w string").select(
        clean_name("d").alias("c"), output_name("d", "v").alias("o"), output_name("d", "w").alias("p")).first()
    assert tuple(row) == ("a_b_c_d", "b-c.d_urls", "b-c.d_urls_x_y")


def test_lineage(spark, rows):
    pairs = spark.createDataFrame(
        [(["o/CC-MAIN-2020-05_urls", "o/a", "o/CC_MAIN_2024_18_urls"], ["o/child"]),
         (["o/a"], ["o/b"])], "sources array<string>, targets array<string>")
    assert rows(lin.lineage_edges(pairs)) == [
        ("Common Crawl", "child"), ("a", "b"), ("a", "child")]
    assert ("fineweb", "fineweb-edu") in rows(lin.family_edges(spark))
    first = spark.createDataFrame([("o/x", 500), ("o/y", 100)], "id string, downloads int")
    second = spark.createDataFrame([("o/x", 900), ("o/z", 101)], "id string, downloads int")
    cards = lin.card_table([first, second])
    assert rows(cards) == [("o/x", 500, "x", False), ("o/z", 101, "z", False)]
    done = lin.mark_collected(cards, spark.createDataFrame([("o/z",), ("o/z",)], "id string"))
    assert {r.id: r.readme_collected for r in done.collect()} == {"o/x": False, "o/z": True}
    used = spark.createDataFrame([("o/x", ["m"]), ("o/x", ["n"]), ("o/y", [])], "dataset string, models array<string>")
    assert [r.dataset_url for r in lin.model_links(used).collect()] == [lin.DATASET_URL + "o/x"]
    urls = spark.createDataFrame([("https://h/datasets/o/t",), ("https://h/other",)], "url string")
    assert rows(lin.registry_parts(urls)) == [
        ("https://h/datasets/o/t", "o", "t", "| [t](https://h/datasets/o/t) | o |")]


def test_samples_repeat_on_any_layout(spark):
    df = spark.range(500).selectExpr("concat('d', id) AS k", "id % 2 AS b")
    for digest in (False, True):
        one = sam.take_shuffled(df, 20, ["k"], digest=digest).toPandas()
        two = sam.take_shuffled(df.repartition(7), 20, ["k"], digest=digest).toPandas()
        assert one.equals(two) and len(one) == 20
        assert not one.equals(sam.take_shuffled(df, 20, ["k"], seed=1, digest=digest).toPandas())
    out = sam.stratified_sample(df, "b", 7, ["k"]).toPandas()
    assert out.groupby("b").size().to_dict() == {0: 7, 1: 7}
    assert set(out["k"]) == set(sam.stratified_sample(df.repartition(3), "b", 7, ["k"]).toPandas()["k"])
