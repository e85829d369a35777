"""Inputs of the named queries, derived from the given tables.

Each is defined twice: as a DataFrame here, and as a SQL common table expression in
``CTES``. All rows of the table they come from take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprov.functions.domains import SuffixRules, with_domain
from corpusprov.functions.urls import path_facets
from corpusprov.operators.counts import domain_counts


#: The hosts of the tables end with common suffixes.
SUFFIXES = SuffixRules.common()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs; the language in the path names the dataset."""
    pages = with_domain(table(spark, sf, "pages").select("url"), rules=SUFFIXES)
    lang = F.get(F.split("url", "/"), F.lit(3))
    return pages.withColumn("dataset_name", F.concat(F.lit("pages_"), lang))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_suppkey").cast("string")
    host = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("www.s"), n, F.lit(".com")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("shop.s"), n, F.lit(".co.uk")))
        .otherwise(F.concat(F.lit("s"), n, F.lit(".com")))
    )
    return table(spark, sf, "lineitem").withColumn("url_host_name", host)


def line_urls(spark: SparkSession, sf: str) -> DataFrame:
    """A derived corpus: one URL per line item, dated unless the item was returned."""
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    dated = F.concat(
        F.lit("/"), F.translate(F.to_date("l_shipdate").cast("string"), "-", "/"), F.lit("/sec"),
        F.col("l_linenumber").cast("string"), F.lit("/"), part)
    path = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("/p/"), part)).otherwise(dated)
    return _lines(spark, sf).select(
        F.concat(F.lit("https://"), F.col("url_host_name"), path).alias("url"),
        F.concat(F.lit("lines_"), F.lower("l_linestatus")).alias("dataset_name"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The derived corpus with hosts and domains."""
    return with_domain(line_urls(spark, sf), rules=SUFFIXES)


def _crawl() -> F.Column:
    year = F.year("l_shipdate").cast("string")
    week = (F.quarter("l_shipdate") * 13).cast("string")
    return F.when(
        F.col("l_linestatus") == "F", F.concat(F.lit("CC-MAIN-"), year, F.lit("-"), week)
    ).otherwise(F.concat(F.lit("CC_MAIN_"), year, F.lit("_"), week))


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl snapshots: URLs per host and snapshot, named in both spellings."""
    rows = _lines(spark, sf).select(_crawl().alias("crawl"), "url_host_name")
    counted = domain_counts(rows, ["crawl"], "url_host_name")
    return counted.withColumn("dataset_name", F.concat("crawl", F.lit("_urls")))


def dataset_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the derived corpora and of the snapshots, without working out any counts."""
    quarter = F.make_date(F.year("l_shipdate"), F.quarter("l_shipdate") * 3, F.lit(1))
    items = table(spark, sf, "lineitem").select("l_linestatus", quarter.alias("l_shipdate")).distinct()
    names = F.array(F.concat(F.lit("lines_"), F.lower("l_linestatus")), F.concat(_crawl(), F.lit("_urls")))
    return items.select(F.explode(names).alias("dataset_name"))


def crawl_index(spark: SparkSession, sf: str) -> DataFrame:
    """One row per crawled URL, with home pages and robots files among them."""
    tail = (
        F.when(F.col("l_discount") == 0, "/")
        .when(F.col("l_tax") == 0, "/robots.txt")
        .otherwise(F.concat(F.lit("/p"), F.col("l_partkey").cast("string")))
    )
    return _lines(spark, sf).select(
        _crawl().alias("crawl"), "url_host_name",
        F.concat(F.lit("https://"), F.col("url_host_name"), tail).alias("url"))


def skewed(spark: SparkSession, sf: str) -> DataFrame:
    """Domains of very different sizes: expensive items crowd into few of them."""
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("d"), F.floor(5000000.0 / F.col("l_extendedprice")).cast("string"))
        .alias("domain"),
        F.concat(F.lit("lines_"), F.lower("l_returnflag")).alias("dataset_name"))
    return domain_counts(rows, ["dataset_name"])


def skewed_all(spark: SparkSession, sf: str) -> DataFrame:
    return skewed(spark, sf).groupBy("domain").agg(F.sum("url_count").alias("url_count"))


def facets(spark: SparkSession, sf: str) -> DataFrame:
    return path_facets(line_urls(spark, sf))


def dates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated stories; an unspecified priority is a missing section."""
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("dataset_name"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("section"))


def _kept_url() -> F.Column:
    return F.when(F.col("url").startswith("https://"), F.col("url"))


def raw_struct(spark: SparkSession, sf: str) -> DataFrame:
    inner = F.struct(_kept_url().alias("warc-target-uri"))
    return table(spark, sf, "pages").select(
        "page_id", F.struct(inner.alias("warc_headers")).alias("meta"))


def raw_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", F.to_json(F.struct(_kept_url().alias("url"), "page_id")).alias("general_metadata"))


def raw_dict(spark: SparkSession, sf: str) -> DataFrame:
    with_url = F.concat(F.lit("{'n': 1, 'url': '"), F.col("url"), F.lit("'}"))
    text = F.when(F.col("url").startswith("https://"), with_url).otherwise("{'n': 1}")
    return table(spark, sf, "pages").select("page_id", text.alias("source_other"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a language's dataset."""
    lang = F.col("lang")
    folder = F.when(lang == "en", "c4").when(lang == "fr", "cc_news").otherwise("other")
    ext = F.when(lang == "en", ".json.gz").when(lang == "fr", ".parquet").otherwise(".csv")
    path = F.concat(F.lit("data/"), folder, F.lit("/"), F.col("source"), F.lit("/doc_"),
                    F.col("doc_id").cast("string"), ext)
    return table(spark, sf, "documents").select(
        lang.alias("dataset_name"), path.alias("path"), F.col("n_chars").alias("size"))


def cards(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Two listings that overlap."""
    docs = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("-"), F.col("n_chars").cast("string"))
        .alias("id"),
        F.col("n_chars").alias("downloads"), "lang")
    return [docs.where(F.col("lang") == "en").drop("lang"), docs.drop("lang")]


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A year's snapshots as parents of both derived corpora, alone and joined by either.

    The last two pairs of a year have one label.
    """
    crawls = _lines(spark, sf).select(
        F.year("l_shipdate").alias("y"),
        F.concat(F.lit("hub/"), _crawl(), F.lit("_urls")).alias("name")).distinct()
    by_year = crawls.groupBy("y").agg(F.array_sort(F.collect_set("name")).alias("crawls"))
    with_other = F.concat("crawls", F.array(F.lit("hub/lines_f")))
    with_itself = F.concat("crawls", F.array(F.lit("hub/lines_o")))
    rows = F.array(
        F.struct(F.col("crawls").alias("sources"), F.array(F.lit("hub/lines_f")).alias("targets")),
        F.struct(F.col("crawls").alias("sources"), F.array(F.lit("hub/lines_o")).alias("targets")),
        F.struct(with_other.alias("sources"), F.array(F.lit("hub/lines_o")).alias("targets")),
        F.struct(with_itself.alias("sources"), F.array(F.lit("hub/lines_o")).alias("targets")))
    return by_year.select(F.inline(rows))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "quality", (F.col("n_chars") >= 1000).cast("int").alias("is_long"),
        (1 - F.col("toxic")).alias("is_clean"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Answers about pages: JSON between fences, cut short for http pages."""
    news = F.when(F.col("url").contains("//blog."), "false").otherwise("true")
    close = F.when(F.col("url").startswith("https://"), "}").otherwise("")
    return table(spark, sf, "pages").select("page_id", F.concat(
        F.lit('Sure.\n```json\n{"url": "'), F.col("url"), F.lit('", "is_news": '), news,
        F.lit(', "reason": "by host"'), close, F.lit("\n```\nDone.")).alias("response"))


_CRAWL_SQL = (
    "CASE WHEN l_linestatus = 'F' THEN 'CC-MAIN-' || year(l_shipdate) || '-' "
    "|| quarter(l_shipdate) * 13 "
    "ELSE 'CC_MAIN_' || year(l_shipdate) || '_' || quarter(l_shipdate) * 13 END"
)
_DOMAIN_SQL = (
    r"CASE WHEN host LIKE '%.co.uk' THEN regexp_extract(host, '([^.]+\.co\.uk)$', 1) "
    r"ELSE regexp_extract(host, '([^.]+\.[^.]+)$', 1) END"
)

CTES: dict[str, tuple[list[str], str]] = {
    "urls": ([], r"""
        SELECT url, host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain,
               'pages_' || split_part(url, '/', 4) AS dataset_name
        FROM (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)"""),
    "items": ([], f"""
        SELECT *, CASE l_returnflag WHEN 'A' THEN 'www.s' || l_suppkey || '.com'
                  WHEN 'N' THEN 'shop.s' || l_suppkey || '.co.uk'
                  ELSE 's' || l_suppkey || '.com' END AS host,
               {_CRAWL_SQL} AS crawl, lower(l_linestatus) AS st
        FROM lineitem"""),
    "lines": (["items"], f"""
        SELECT 'https://' || host || CASE WHEN l_returnflag = 'R' THEN '/p/p' || l_partkey
                   ELSE strftime(l_shipdate, '/%Y/%m/%d') || '/sec' || l_linenumber
                        || '/p' || l_partkey END AS url,
               'lines_' || st AS dataset_name, host, {_DOMAIN_SQL} AS domain
        FROM items"""),
    "hosts": (["items"], """
        SELECT crawl, host AS url_host_name, count(*) AS url_count,
               crawl || '_urls' AS dataset_name
        FROM items GROUP BY crawl, host"""),
    "crawl_index": (["items"], """
        SELECT crawl, host AS url_host_name, 'https://' || host ||
               CASE WHEN l_discount = 0 THEN '/' WHEN l_tax = 0 THEN '/robots.txt'
                    ELSE '/p' || l_partkey END AS url
        FROM items"""),
    "skewed": ([], """
        SELECT 'd' || CAST(floor(5000000.0::DOUBLE / l_extendedprice) AS BIGINT) AS domain,
               'lines_' || lower(l_returnflag) AS dataset_name, count(*) AS url_count
        FROM lineitem GROUP BY 1, 2"""),
    "skewed_all": (["skewed"], """
        SELECT domain, CAST(sum(url_count) AS BIGINT) AS url_count FROM skewed GROUP BY domain"""),
    "facets": (["lines"], """
        SELECT url, dataset_name, CASE WHEN ok THEN y END AS year,
               CASE WHEN ok THEN s END AS section
        FROM (SELECT *, y IS NOT NULL AND s IS NOT NULL AS ok
              FROM (SELECT url, dataset_name,
                           TRY_CAST(string_split(url, '/')[4] AS BIGINT) AS y,
                           string_split(url, '/')[7] AS s FROM lines))"""),
    "dates": ([], """
        SELECT o_orderstatus AS dataset_name, CAST(year(o_orderdate) AS INT) AS year,
               CAST(month(o_orderdate) AS INT) AS month,
               nullif(o_orderpriority, '4-NOT SPECIFIED') AS section
        FROM orders"""),
    "kept": ([], """
        SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url END AS url FROM pages"""),
    "manifest": ([], """
        SELECT lang AS dataset_name,
               'data/' || CASE lang WHEN 'en' THEN 'c4' WHEN 'fr' THEN 'cc_news' ELSE 'other' END
               || '/' || source || '/doc_' || doc_id
               || CASE lang WHEN 'en' THEN '.json.gz' WHEN 'fr' THEN '.parquet' ELSE '.csv' END
               AS path,
               n_chars AS size
        FROM documents"""),
    "batched": (["manifest"], """
        SELECT dataset_name, path, size, CAST(batch AS INT) AS batch FROM (
          WITH RECURSIVE ordered AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY size DESC, path) AS rn
            FROM manifest),
          walk AS (
            SELECT dataset_name, path, size, rn, 1 AS batch, size AS used FROM ordered WHERE rn = 1
            UNION ALL
            SELECT o.dataset_name, o.path, o.size, o.rn,
                   CASE WHEN w.used + o.size > 100000 THEN w.batch + 1 ELSE w.batch END,
                   CASE WHEN w.used + o.size > 100000 THEN o.size ELSE w.used + o.size END
            FROM walk w JOIN ordered o ON o.dataset_name = w.dataset_name AND o.rn = w.rn + 1)
          SELECT * FROM walk)"""),
    "listings": ([], """
        SELECT id, downloads, listing FROM (
          SELECT source || '/' || lang || '-' || n_chars AS id, n_chars AS downloads, lang
          FROM documents) d, (VALUES (0), (1)) l(listing)
        WHERE lang = 'en' OR listing = 1"""),
    "pairs": (["items"], """
        SELECT p.sources, p.targets FROM (
          SELECT list_sort(list(DISTINCT 'hub/' || crawl || '_urls')) AS c
          FROM items GROUP BY year(l_shipdate)) y,
        LATERAL (SELECT c AS sources, ['hub/lines_f'] AS targets
                 UNION ALL SELECT c, ['hub/lines_o']
                 UNION ALL SELECT list_append(c, 'hub/lines_f'), ['hub/lines_o']
                 UNION ALL SELECT list_append(c, 'hub/lines_o'), ['hub/lines_o']) p"""),
    "keyed": (["pairs"], """
        SELECT *, CASE WHEN len(sources) = 1 THEN split_part(sources[1], '/', -1)
                  ELSE len(sources) || '_sources_'
                       || split_part(split_part(sources[1], '/', -1), '_', 1) END
               || '_to_' || split_part(targets[1], '/', -1) AS pair_key,
               array_to_string(sources, ',') || '>' || array_to_string(targets, ',') AS pair
        FROM pairs"""),
    "members": (["keyed"], """
        SELECT DISTINCT pair, pair_key, side, split_part(m, '/', -1) AS dataset_name FROM (
          SELECT pair, pair_key, 'p' AS side, unnest(sources) AS m FROM keyed
          UNION ALL SELECT pair, pair_key, 'q', unnest(targets) FROM keyed)"""),
    "unified": (["lines", "hosts"], """
        SELECT dataset_name, domain, count(*) AS url_count FROM lines GROUP BY 1, 2
        UNION ALL
        SELECT dataset_name, domain, CAST(sum(url_count) AS BIGINT) FROM (
          SELECT dataset_name, url_count, """ + _DOMAIN_SQL + """ AS domain
          FROM (SELECT *, url_host_name AS host FROM hosts)) GROUP BY 1, 2"""),
    "unified_hosts": (["lines", "hosts"], """
        SELECT dataset_name, host AS domain, count(*) AS url_count FROM lines GROUP BY 1, 2
        UNION ALL SELECT dataset_name, url_host_name, url_count FROM hosts"""),
    "scored": ([], """
        SELECT quality, CAST(n_chars >= 1000 AS INT) AS is_long, 1 - toxic AS is_clean
        FROM documents JOIN labels USING (doc_id)"""),
    "mentions": ([], """
        SELECT d.doc_id, b.item_id AS term_id FROM documents d
        JOIN benchmark b ON b.text <> '' AND contains(lower(d.text), lower(b.text))
        GROUP BY ALL"""),
}


def with_ctes(names: list[str], body: str) -> str:
    """``body`` behind the named common table expressions and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {head}\n{body}"
