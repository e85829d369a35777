import random

import pytest
from corpusprov.functions import (
    SuffixRules, domain_sql, domains_by_join, register_domain_functions, url_host_sql, with_domain,
)

COMMON = SuffixRules.common()
CASES = [
    ("https://www.bbc.co.uk/news", "www.bbc.co.uk", "bbc.co.uk"),
    ("www.bbc.co.uk", "www.bbc.co.uk", "bbc.co.uk"),
    ("http://a_b.example.com", "a_b.example.com", "example.com"),
    ("http://u:p@h.Example.com:80/x", "h.example.com", "example.com"),
    ("http://user@name@h.example.com/", "h.example.com", "example.com"),
    ("https://h.example.com?q=a.b/c", "h.example.com", "example.com"),
    ("https://h.example.com#top", "h.example.com", "example.com"),
    ("//cdn.example.org/x.js", "cdn.example.org", "example.org"),
    ("http://foo.github.io", "foo.github.io", "github.io"),
    ("http://127.0.0.1/", "127.0.0.1", None),
    ("http://[::1]:8080/", "[::1]", None),
    ("http://1.2.3.400/", "1.2.3.400", "3.400"),
    ("localhost", "localhost", None),
    ("http://co.uk/", "co.uk", None),
    ("http://www.ck/", "www.ck", "www.ck"),
    ("http://a.b.ck/", "a.b.ck", "a.b.ck"),
    ("http://b.ck/", "b.ck", None),
    ("http://example.com./", "example.com", "example.com"),
    ("http://exa mple/", "exa mple", None),
    ("", None, None),
    (None, None, None),
]


def test_host_and_domain(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(CASES)], "i int, url string")
    got = {r.i: (r.host, r.domain) for r in with_domain(df, rules=COMMON).collect()}
    assert got == {i: (h, d) for i, (_, h, d) in enumerate(CASES)}


PIECES = ["http://", "https://", "//", "/", "?", "#", "@", ":", "[", "]", ".", "a", "B-c", "co.uk",
          "ftp:", " ", "1.2", "é", "::1", "_"]


def test_both_ways_to_the_host_agree(spark):
    rnd = random.Random(11)
    urls = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(8))) for _ in range(5000)]
    df = spark.createDataFrame([(u,) for u in urls + [u for u, _, _ in CASES]], "url string")
    for strict in (False, True):
        both = with_domain(df, rules=COMMON, strict_parity=strict).selectExpr(
            "url", "host", f"{url_host_sql('url', keep_case=strict)} AS other",
            "domain", f"{domain_sql('host', COMMON, strict_parity=strict)} AS other_domain")
        wrong = both.where("NOT (host <=> other AND domain <=> other_domain)")
        assert [tuple(r) for r in wrong.limit(5).collect()] == []


def test_strict_parity_keeps_both_parts(spark):
    cases = {
        "http://localhost/": "localhost.", "http://127.0.0.1/": "127.0.0.1.", "": ".",
        "https://WWW.Example.COM/": "Example.COM", "http://co.uk/": ".co.uk",
        "https://www.bbc.co.uk/": "bbc.co.uk", "http://exa mple/": "exa mple.",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r.url: r.domain for r in with_domain(df, rules=COMMON, strict_parity=True).collect()}
    assert got == cases


def test_suffix_file(spark, tmp_path):
    path = tmp_path / "suffixes.dat"
    path.write_text(
        "// comment\n\ncom\nco.uk\n*.kawasaki.jp\n!city.kawasaki.jp\njp\nmünchen.museum\n"
        "// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n", encoding="utf-8")
    rules = SuffixRules.from_file(spark, str(path), default_rule=False)
    assert "github.io" not in rules.plain
    assert "github.io" in SuffixRules.from_file(spark, str(path), private=True).plain
    urls = {
        "http://x.y.example.com": "example.com",
        "http://a.b.kawasaki.jp": "a.b.kawasaki.jp",
        "http://b.kawasaki.jp": None,
        "http://x.city.kawasaki.jp": "city.kawasaki.jp",
        "http://kawasaki.jp": "kawasaki.jp",
        "http://a.xn--mnchen-3ya.museum": "a.xn--mnchen-3ya.museum",
        "http://a.unlisted": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.domain for r in with_domain(df, rules=rules).collect()} == urls


def test_bad_rule_is_refused():
    with pytest.raises(ValueError):
        SuffixRules.from_rules(["it's.com"])


def test_sql_functions(spark):
    register_domain_functions(spark, COMMON)
    row = spark.sql("SELECT extract_domain('https://a.b.co.uk/x') d, url_host('https://a.b.co.uk/x') h,"
                    " extract_domain(CAST(NULL AS STRING)) n").first()
    assert (row.d, row.h, row.n) == ("b.co.uk", "a.b.co.uk", None)
    register_domain_functions(spark, COMMON, strict_parity=True)
    row = spark.sql("SELECT extract_domain('') e, extract_domain(CAST(NULL AS STRING)) n").first()
    assert (row.e, row.n) == (".", None)
    register_domain_functions(spark, COMMON)


def test_no_python_no_shuffle_and_one_parse_per_filter(spark):
    df = with_domain(spark.range(10).selectExpr("concat('http://a.b', id, '.com') AS url"), rules=COMMON)
    plan = df.where("domain = 'b1.com'")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.count("regexp_replace") == 1
    assert all(ln.startswith(("*", "+- *", " ")) for ln in plan.splitlines() if "Project" in ln)


def test_suffixes_must_be_named(spark):
    df = spark.range(1).selectExpr("'http://a.b.com' AS url")
    for call in (lambda: with_domain(df), lambda: domain_sql("host"), lambda: register_domain_functions(spark)):
        with pytest.raises(ValueError, match="say which suffixes"):
            call()


LISTED = ["com", "uk", "co.uk", "tz", "co.tz", "gr", "com.gr", "us", "ca.us", "k12.ca.us", "*.ck", "!www.ck", "jp",
          "*.kawasaki.jp", "!city.kawasaki.jp", None, ""]
LISTED_HOSTS = {
    "www.shop.co.tz": "shop.co.tz", "a.b.com.gr": "b.com.gr", "www.school.k12.ca.us": "school.k12.ca.us",
    "x.ca.us": "x.ca.us", "k12.ca.us": None, "co.tz": None, "www.ck": "www.ck", "a.www.ck": "www.ck", "a.b.ck": "a.b.ck",
    "b.ck": None, "ck": None, "x.city.kawasaki.jp": "city.kawasaki.jp", "a.b.kawasaki.jp": "a.b.kawasaki.jp",
    "kawasaki.jp": "kawasaki.jp", "a.unlisted": "a.unlisted", "localhost": None, "127.0.0.1": None, "[::1]": None,
    "WWW.Shop.CO.TZ": "shop.co.tz", None: None,
}


@pytest.mark.parametrize("small", [True, False])
def test_a_list_given_as_a_table(spark, monkeypatch, small):
    """The join with a table of rules gives what rules in the expression give."""
    from corpusprov.functions import domains

    if not small:
        monkeypatch.setattr(domains, "broadcast_if_small", lambda df: df)
    table = spark.createDataFrame([(r,) for r in LISTED], "rule string")
    hosts = [(i, h) for i, h in enumerate([*LISTED_HOSTS, "www.shop.co.tz"])]
    df = spark.createDataFrame(hosts, "i int, host string")
    got = {r.i: r.domain for r in domains_by_join(df, "host", table).collect()}
    assert [got[i] for i, _ in hosts] == [LISTED_HOSTS[h] for _, h in hosts]
    rules = SuffixRules.from_table(table.where("rule != ''"))
    other = domains.host_to_domain(df, "host", rules=rules)
    assert {r.i: r.domain for r in other.collect()} == got
    alone = domains_by_join(df, "host", table, default_rule=False).where("host = 'a.unlisted'").first()
    assert alone.domain is None
    with pytest.raises(ValueError, match="domains_by_join"):
        SuffixRules.from_table(table, most=3)
    assert domains_by_join(df, "host", table.limit(0)).where("domain = 'co.tz'").count() == 4


def test_sql_function_is_plain_cuts(spark):
    register_domain_functions(spark, COMMON)
    df = spark.range(10).selectExpr("concat('http://a.b', id, '.com') AS url").selectExpr("extract_domain(url) AS d")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Python" not in plan and "Exchange" not in plan
    assert sorted(r.d for r in df.collect()) == [f"b{i}.com" for i in range(10)]
    assert spark.sql("SELECT 1 WHERE extract_domain('http://x.a.co.uk') = 'a.co.uk'").count() == 1
