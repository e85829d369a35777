"""SQL that gives the same rows as the named queries."""

from __future__ import annotations

from corpusprov.operators.lineage import FAMILY_EDGES
from corpusprov.plans.inputs import with_ctes
from corpusprov.sources.rules import all_rules

_CARDS = """
    SELECT id, downloads, split_part(id, '/', -1) AS name, false AS readme_collected
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY listing, downloads DESC) AS rn
          FROM listings WHERE downloads > 100) WHERE rn = 1"""

_RANKED = """
    SELECT dataset_name, url_count,
           row_number() OVER (PARTITION BY dataset_name ORDER BY url_count) AS r,
           sum(url_count) OVER (PARTITION BY dataset_name ORDER BY url_count
                                ROWS UNBOUNDED PRECEDING)::DOUBLE AS cum,
           count(*) OVER (PARTITION BY dataset_name) AS n,
           sum(url_count) OVER (PARTITION BY dataset_name)::DOUBLE AS t
    FROM skewed"""

_SECTIONS = """
    SELECT s.dataset_name, s.section, s.n, s.n::DOUBLE / t.total AS percentage
    FROM (SELECT dataset_name, section, count(*) AS n FROM {0}
          WHERE section IS NOT NULL GROUP BY 1, 2) s
    JOIN (SELECT dataset_name, count(*) AS total FROM {0} GROUP BY 1) t USING (dataset_name)"""


def _kl(p: str, q: str) -> str:
    """KL of two (domain, n) subqueries, as the sum of p * ln(p / q)."""
    return f"""
    SELECT round(sum(pp * ln(pp / coalesce(qp, 1e-12))), 9) AS kl_divergence
    FROM (SELECT domain, sum(n)::DOUBLE / (SELECT sum(n) FROM ({p})) AS pp FROM ({p}) GROUP BY 1)
    LEFT JOIN (SELECT domain, sum(n)::DOUBLE / (SELECT sum(n) FROM ({q})) AS qp
               FROM ({q}) GROUP BY 1) USING (domain)"""


def _kl_pairs(counts: str, merge: bool, places: int) -> str:
    group = "GROUP BY 1, 2, 3, 4" if merge else "GROUP BY 1, 2, 3, 4, u.dataset_name"
    return f"""
    , rows AS (SELECT m.pair, m.pair_key, m.side, u.domain, sum(u.url_count)::DOUBLE AS n
               FROM {counts} u JOIN members m ON u.dataset_name = m.dataset_name {group}),
    probs AS (SELECT *, n / sum(n) OVER (PARTITION BY pair, side) AS pr FROM rows)
    SELECT p.pair_key, round(sum(p.pr * ln(p.pr / coalesce(q.pr, 1e-12))), {places})
           AS kl_divergence
    FROM (SELECT * FROM probs WHERE side = 'p') p
    LEFT JOIN (SELECT * FROM probs WHERE side = 'q') q
      ON p.pair = q.pair AND p.domain = q.domain
    GROUP BY p.pair, p.pair_key"""


def _thresholds() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({t} AS BIGINT) AS threshold, count(*) AS n_domains "
        f"FROM skewed_all WHERE url_count >= {t}"
        for t in (10, 100, 500, 1000, 10000, 100000))


def _rule_values() -> str:
    """The rules' output names, suffixes, prefixes and excludes as literal rows."""
    def texts(values) -> str:
        return "CAST([" + ", ".join(f"'{v}'" for v in values) + "] AS VARCHAR[])"

    rows = []
    for r in all_rules():
        variant = "" if r.variant == "default" else f"_{r.variant}"
        name = f"{r.dataset.split('/')[-1]}_urls{variant}"
        rows.append(f"('{name}', '{r.suffix}', {texts(r.prefixes)}, {texts(r.excludes)})")
    return ", ".join(rows)


def _metrics(model: str, column: str) -> str:
    return f"""
    SELECT '{model}' AS model, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 9) AS accuracy,
           round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
           round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
           round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1
    FROM (SELECT count(*) FILTER ({column} = 1 AND quality = 1) AS tp,
                 count(*) FILTER ({column} = 1 AND quality = 0) AS fp,
                 count(*) FILTER ({column} = 0 AND quality = 1) AS fn,
                 count(*) FILTER ({column} = 0 AND quality = 0) AS tn FROM scored)"""


def _shape(name: str) -> str:
    return (f"SELECT (SELECT count(*) FROM {name}) AS n_rows, "
            f"CAST((SELECT count(*) FROM (DESCRIBE {name})) AS INT) AS n_columns, "
            f"'{name}' AS table_name")


_GINI = """
    SELECT {by} round((n + 1 - 2 * sum(cum) / max(cum)) / n, 9) AS gini
    FROM (SELECT {by} sum(url_count) OVER ({part} ORDER BY url_count ROWS UNBOUNDED PRECEDING)
                 ::DOUBLE AS cum, count(*) OVER ({part}) AS n FROM {source})
    GROUP BY {by} n"""

_BUCKETS = [("1", 1, 2), ("2-9", 2, 10), ("10-99", 10, 100), ("100-999", 100, 1000),
            ("1K-9.9K", 1000, 10000), ("10K-99K", 10000, 100000), ("100K+", 100000, 10**15)]
_CUTS = [("one", 0, 1), ("small", 1, 10), ("medium", 10, 100), ("large", 100, 1000),
         ("very_large", 1000, 10**15)]
_CUT_CASE = ("CASE " + " ".join(
    f"WHEN url_count > {lo} AND url_count <= {hi} THEN '{name}'" for name, lo, hi in _CUTS)
    + " END")


def _drawn() -> str:
    """The hand-drawn edges as literal rows."""
    edges = (line.split(" > ") for line in FAMILY_EDGES.strip().splitlines())
    return ", ".join(f"('{a}', '{b}')" for a, b in edges)


# Least squares over all borders of runs of counts, one number of clusters after the other.
_CLUSTERS = """
    , points AS (SELECT row_number() OVER (ORDER BY url_count) AS j, url_count::DOUBLE AS x, count(*)::DOUBLE AS m
                 FROM skewed_all GROUP BY url_count),
    sums AS MATERIALIZED (
      SELECT 0::BIGINT AS j, 0::DOUBLE AS n, 0::DOUBLE AS s, 0::DOUBLE AS t UNION ALL
      SELECT j, sum(m) OVER w, sum(m * x) OVER w, sum(m * x * x) OVER w FROM points WINDOW w AS (ORDER BY j)),
    fill AS (
      SELECT 1 AS k, j, {'v': t - s * s / n, 'i': 0::BIGINT} AS best FROM sums WHERE j > 0
      UNION ALL
      SELECT any_value(f.k) + 1, b.j,
             min({'v': f.best.v + ((b.t - a.t) - (b.s - a.s) * (b.s - a.s) / (b.n - a.n)), 'i': f.j})
      FROM fill f JOIN sums a ON a.j = f.j JOIN sums b ON b.j > f.j WHERE f.k < 10 GROUP BY b.j),
    back AS (
      SELECT k AS total, k, j, best.i AS i FROM fill WHERE j = (SELECT max(j) FROM sums) AND k BETWEEN 3 AND 10
      UNION ALL
      SELECT b.total, f.k, f.j, f.best.i FROM back b JOIN fill f ON f.k = b.k - 1 AND f.j = b.i WHERE b.k > 1),
    labelled AS (SELECT b.total AS k, b.k - 1 AS cluster, p.x, p.m FROM back b JOIN points p ON p.j > b.i AND p.j <= b.j)"""


def oracle_sql() -> dict[str, str]:
    w = with_ctes

    def recursive(names: list[str], body: str) -> str:
        return w(names, body).replace("WITH ", "WITH RECURSIVE ", 1)

    return {
        "scan_parquet_urls": "SELECT url FROM pages WHERE url IS NOT NULL",
        "url_domain_table": w(["urls"], "SELECT url, domain FROM urls"),
        "read_ndjson": "SELECT * FROM conversations",
        "read_csv": "SELECT * FROM pages",
        "csv_round_trip": "SELECT * FROM documents",
        "list_manifest": "SELECT DISTINCT o_orderstatus AS folder, true AS filled FROM orders",
        "compacted": w(["urls"], """
            SELECT url, domain, 'lists' AS writer, 'pages' AS dataset_name,
                   CASE WHEN domain < 'm' THEN 1 ELSE 2 END AS batch FROM urls"""),
        "url_stream": w(["urls"], "SELECT url, domain, 'pages' AS dataset_name FROM urls"),
        "extract_domain_sql": w(["lines"], "SELECT url, host, domain FROM lines"),
        "dataset_slice": w(["urls"], "SELECT dataset_name, url, domain FROM urls "
                                "WHERE dataset_name IN ('pages_de', 'pages_fr')"),
        "like_urls": w(["lines"], "SELECT url FROM lines WHERE url LIKE '%.s1.co.uk%'"),
        "crawl_index_host_urls": w(["crawl_index"], """
            SELECT url FROM crawl_index
            WHERE crawl = 'CC-MAIN-1998-13' AND url_host_name = 'www.s1.com'
              AND url NOT IN ('https://www.s1.com', 'https://www.s1.com/')
              AND url NOT LIKE '%robots.txt'"""),
        "url_from_struct": w(["kept"], "SELECT page_id, url FROM kept"),
        "url_from_json": w(["kept"], "SELECT page_id, url FROM kept"),
        "url_from_dict_text": w(["kept"], "SELECT page_id, url, coalesce(url, '') AS url_text "
                                "FROM kept"),
        "domain_lookup": w(["lines"], "SELECT domain, count(*) AS url_count FROM lines "
                           "WHERE domain = 's1.co.uk' GROUP BY 1"),
        "path_facets": w(["facets"], "SELECT url, year, section FROM facets"),
        "url_column_scan": """
            SELECT 'pages' AS table_name, 'url' AS column_name,
                   (SELECT bool_or(regexp_matches(url, 'https?://[-\\w.]+')) FROM pages) AS has_urls
            UNION ALL
            SELECT 'documents', 'source',
                   (SELECT bool_or(regexp_matches(source, '[a-zA-Z0-9]\\.[^\\s]{2,}'))
                    FROM documents)
            UNION ALL SELECT 'events', NULL, false""",
        "domain_counts": w(["urls"], "SELECT dataset_name, domain, count(*) AS url_count "
                           "FROM urls GROUP BY 1, 2"),
        "domain_counts_lines": w(["lines"], "SELECT dataset_name, domain, count(*) AS url_count "
                                 "FROM lines GROUP BY 1, 2"),
        "domain_counts_unified": w(["unified"], "SELECT * FROM unified"),
        "host_counts_merged": w(["hosts"], "SELECT url_host_name, CAST(sum(url_count) AS BIGINT) "
                                "AS url_count FROM hosts GROUP BY 1"),
        "combined_host_counts": w(["hosts"], """
            SELECT url_host_name, CAST(sum(url_count) AS BIGINT) AS total_count FROM hosts
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""),
        "domain_share": w(["skewed_all"], """
            SELECT domain, url_count, round(url_count::DOUBLE
                   / (SELECT sum(url_count) FROM skewed_all), 9) AS percentage FROM skewed_all"""),
        "top_domains": w(["skewed_all"], """
            SELECT domain, url_count, round(url_count::DOUBLE
                   / (SELECT sum(url_count) FROM skewed_all) * 100, 9) AS pct_urls
            FROM skewed_all ORDER BY 2 DESC, 1 LIMIT 10"""),
        "top10_share": w(["skewed_all"], """
            SELECT round(sum(url_count)::DOUBLE / (SELECT sum(url_count) FROM skewed_all), 9)
                   AS top_share, median(url_count) AS median_count
            FROM (SELECT * FROM skewed_all ORDER BY url_count DESC, domain LIMIT 10)"""),
        "top10_vs_median": w(["skewed_all"], """
            , tot AS (SELECT sum(url_count)::DOUBLE AS t FROM skewed_all),
            med AS (SELECT median(url_count)::DOUBLE AS c FROM skewed_all),
            best AS (SELECT sum(url_count)::DOUBLE AS s FROM
                     (SELECT * FROM skewed_all ORDER BY url_count DESC, domain LIMIT 10))
            SELECT round(c / t, 9) AS med_pct, c AS med_cnt, round((s / t) / (c / t), 6) AS ratio
            FROM tot, med, best"""),
        "threshold_counts": w(["skewed_all"], _thresholds()),
        "threshold_and_match": w(["lines"], """
            SELECT count(*) FILTER (regexp_matches(domain, 's1.co.uk')) AS matching,
                   count(*) AS total,
                   round(count(*) FILTER (regexp_matches(domain, 's1.co.uk'))::DOUBLE
                         / count(*), 9) AS ratio FROM lines"""),
        "match_fraction_rows": w(["urls"], """
            SELECT count(*) FILTER (url LIKE '%blog.%') AS matching, count(*) AS total,
                   round(count(*) FILTER (url LIKE '%blog.%')::DOUBLE / count(*), 9) AS ratio
            FROM urls"""),
        "match_fraction_counts": w(["hosts"], """
            SELECT CAST(m AS BIGINT) AS matching, CAST(t AS BIGINT) AS total,
                   round(m::DOUBLE / t, 9) AS ratio
            FROM (SELECT sum(url_count) FILTER (url_host_name LIKE '%s1.com%') AS m,
                         sum(url_count) AS t FROM hosts)"""),
        "corpus_ratio": w(["hosts"], """
            SELECT c AS corpus_total, CAST(t AS BIGINT) AS crawl_total,
                   round(c::DOUBLE / t, 9) AS ratio
            FROM (SELECT count(*) AS c FROM pages), (SELECT sum(url_count) AS t FROM hosts)"""),
        "snapshot_totals": w(["hosts"], "SELECT dataset_name, CAST(sum(url_count) AS BIGINT) "
                             "AS total_urls FROM hosts GROUP BY 1"),
        "distinct_domains": w(["hosts"], "SELECT DISTINCT url_host_name FROM hosts"),
        "snapshot_stats": w(["hosts"], """
            SELECT dataset_name, count(DISTINCT url_host_name) AS total_hosts,
                   CAST(sum(url_count) AS BIGINT) AS total_urls,
                   median(url_count)::DOUBLE AS median_urls,
                   quantile_cont(url_count, 0.25)::DOUBLE AS urls_25th,
                   quantile_cont(url_count, 0.75)::DOUBLE AS urls_75th
            FROM hosts GROUP BY 1"""),
        "snapshot_timeline": w(["hosts"], """
            SELECT dataset_name, total_urls, year, week,
                   CAST(strptime(year || ' ' || week || ' 1', '%Y %W %w') AS DATE) AS monday
            FROM (SELECT dataset_name, CAST(sum(url_count) AS BIGINT) AS total_urls,
                         CAST(dataset_name[9:12] AS INT) AS year,
                         CAST(dataset_name[14:15] AS INT) AS week FROM hosts GROUP BY 1)"""),
        "language_share": """
            SELECT source, lang, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY source), 9)
                   AS share
            FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)""",
        "source_share": """
            SELECT lang, source, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang), 9) AS share
            FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)""",
        "table_shape": " UNION ALL ".join(
            _shape(t) for t in ("pages", "documents", "events", "lineitem", "orders")),
        "kl_divergence": w(["unified"], _kl(
            "SELECT domain, url_count AS n FROM unified WHERE dataset_name LIKE 'CC%'",
            "SELECT domain, url_count AS n FROM unified WHERE dataset_name = 'lines_o'")),
        "kl_divergence_hosts": w(["urls"], _kl(
            "SELECT host AS domain, 1 AS n FROM urls WHERE dataset_name = 'pages_en'",
            "SELECT host AS domain, 1 AS n FROM urls WHERE dataset_name <> 'pages_en'")),
        "kl_all_pairs": w(["members", "unified"], _kl_pairs("unified", True, 9)),
        "kl_resume": w(["members", "unified"], _kl_pairs("unified", True, 9)),
        "kl_all_pairs_hosts": w(["members", "unified_hosts"],
                                _kl_pairs("unified_hosts", True, 9)),
        "kl_all_pairs_unmerged": w(["members", "unified_hosts"],
                                   _kl_pairs("unified_hosts", False, 6)),
        "pair_keys": w(["keyed"], "SELECT pair_key FROM keyed"),
        "lineage_edges": w(["pairs"], """
            SELECT DISTINCT source, target FROM (
              SELECT targets, sources, split_part(targets[1], '/', -1) AS target,
                     unnest(list_distinct(list_transform(sources, lambda s:
                       CASE WHEN contains(s, '/CC') THEN 'Common Crawl'
                            ELSE split_part(s, '/', -1) END))) AS source FROM pairs)
            """.replace("SELECT DISTINCT", "SELECT")),
        "clean_names": w(["hosts"], """
            SELECT 'hub_' || replace(dataset_name, '-', '_') || '_v1' AS clean,
                   dataset_name || '.v1_urls' AS output,
                   dataset_name || '.v1_urls_noisy' AS output_noisy
            FROM (SELECT DISTINCT dataset_name FROM hosts)"""),
        "gini": w(["skewed_all"], _GINI.format(by="", part="", source="skewed_all")),
        "gini_by_dataset": w(["skewed"], _GINI.format(
            by="dataset_name,", part="PARTITION BY dataset_name", source="skewed")),
        "lorenz_curve": w(["skewed"], f"""
            SELECT dataset_name, url_count, round(max(100.0::DOUBLE * r / n), 7) AS pct_domains,
                   round(max(100.0::DOUBLE * cum / t), 7) AS pct_urls
            FROM ({_RANKED}) GROUP BY 1, 2"""),
        "top_share_pct": w(["skewed"], f"""
            SELECT dataset_name,
                   round(100 - max(cum) FILTER (r = CAST(floor(0.99::DOUBLE * n) AS BIGINT) + 1)
                         / max(t) * 100, 7) AS top_1_pct,
                   round(100 - max(cum) FILTER (r = CAST(floor(0.9::DOUBLE * n) AS BIGINT) + 1)
                         / max(t) * 100, 7) AS top_10_pct,
                   max(url_count) FILTER (r = n // 2 + 1) AS median_urls
            FROM ({_RANKED}) GROUP BY 1"""),
        "size_bucket_pct": w(["skewed"], " UNION ALL ".join(
            f"SELECT dataset_name, '{name}' AS bucket, round(100.0::DOUBLE * count(*) FILTER "
            f"(url_count >= {lo} AND url_count < {hi}) / count(*), 9) AS pct_domains "
            f"FROM skewed GROUP BY 1" for name, lo, hi in _BUCKETS)),
        "log_histogram": w(["skewed_all"], """
            , top AS (SELECT log10(max(url_count)::DOUBLE) AS lt FROM skewed_all),
            edges AS (SELECT k AS bin, pow(10.0::DOUBLE, lt * k / 49) AS low,
                             pow(10.0::DOUBLE, lt * (k + 1) / 49) AS high
                      FROM top, range(49) t(k))
            SELECT CAST(bin AS BIGINT) AS bin, round(low, 6) AS low, round(high, 6) AS high,
                   (SELECT count(*) FROM skewed_all s WHERE s.url_count >= e.low
                    AND (s.url_count < e.high OR e.bin = 48)) AS n_domains
            FROM edges e"""),
        "count_summary": w(["skewed"], """
            SELECT dataset_name, count(*) AS n_domains, round(avg(url_count), 9) AS mean_urls,
                   median(url_count)::DOUBLE AS median_urls, max(url_count) AS max_urls
            FROM skewed GROUP BY 1"""),
        "cluster_ranges": recursive(["skewed_all"], _CLUSTERS + """
            SELECT CAST(cluster AS INT) AS cluster, CAST(min(x) AS BIGINT) AS min_count, CAST(max(x) AS BIGINT) AS max_count,
                   CAST(sum(m) AS BIGINT) AS n_domains FROM labelled WHERE k = 7 GROUP BY cluster"""),
        "cluster_choice": recursive(["skewed_all"], _CLUSTERS + """
            , inside AS (SELECT a.k, a.cluster, a.x, any_value(a.m) AS m, sum(b.m * abs(a.x - b.x)) AS d, sum(b.m) AS n
                         FROM labelled a JOIN labelled b USING (k, cluster) GROUP BY a.k, a.cluster, a.x),
            outside AS (SELECT k, x, min(d) AS b FROM (
                          SELECT a.k, a.x, sum(b.m * abs(a.x - b.x)) / sum(b.m) AS d FROM labelled a
                          JOIN labelled b ON a.k = b.k AND a.cluster <> b.cluster GROUP BY a.k, a.x, b.cluster)
                        GROUP BY k, x),
            scored AS (SELECT k, sum(m * CASE WHEN n = 1 THEN 0 ELSE (b - d / (n - 1)) / greatest(b, d / (n - 1)) END)
                              / sum(m) AS silhouette FROM inside JOIN outside USING (k, x) GROUP BY k)
            SELECT CAST(k AS INT) AS k, round(silhouette, 6) AS silhouette,
                   row_number() OVER (ORDER BY silhouette DESC, k) = 1 AS chosen FROM scored"""),
        "cut_bucket_counts": w(["skewed_all"], " UNION ALL ".join(
            f"SELECT '{name}' AS bucket, count(*) FILTER (url_count > {lo} AND url_count <= {hi})"
            f" AS n_domains FROM skewed_all" for name, lo, hi in _CUTS)),
        "section_share": w(["facets"], """
            SELECT section, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share
            FROM (SELECT section, count(*) AS n FROM facets WHERE section IS NOT NULL
                  GROUP BY 1)"""),
        "section_share_delta": w(["facets"], """
            , shares AS (SELECT dataset_name, section, n::DOUBLE
                         / sum(n) OVER (PARTITION BY dataset_name) AS s
                         FROM (SELECT dataset_name, section, count(*) AS n FROM facets
                               WHERE section IS NOT NULL GROUP BY 1, 2)),
            both_sides AS (SELECT section, coalesce(p.s, 0) AS ps, coalesce(c.s, 0) AS cs
                     FROM (SELECT * FROM shares WHERE dataset_name = 'lines_f') p
                     FULL JOIN (SELECT * FROM shares WHERE dataset_name = 'lines_o') c
                     USING (section))
            SELECT section, round(ps, 9) AS parent_share, round(cs, 9) AS child_share,
                   round(cs - ps, 9) AS delta FROM both_sides WHERE ps > 0.01 OR cs > 0.01"""),
        "section_pct_by_dataset": w(["dates"], "SELECT dataset_name, section, n, "
                                    "round(percentage, 9) AS percentage FROM ("
                                    + _SECTIONS.format("dates") + ")"),
        "top_sections": w(["facets"], """
            SELECT dataset_name, section, n, percentage FROM (
              SELECT *, row_number() OVER (PARTITION BY dataset_name
                                           ORDER BY percentage DESC, section) AS rn
              FROM (SELECT dataset_name, section, n, round(percentage, 9) AS percentage FROM ("""
                          + _SECTIONS.format("facets") + "))) WHERE rn <= 3"),
        "common_sections": w(["dates"], """
            SELECT section FROM dates WHERE dataset_name = 'F' AND section IS NOT NULL
            INTERSECT
            SELECT section FROM dates WHERE dataset_name = 'P' AND section IS NOT NULL"""),
        "common_section_delta": w(["dates"], ", s AS (" + _SECTIONS.format("dates") + """)
            SELECT section, round(a.percentage, 9) AS first_pct,
                   round(b.percentage, 9) AS second_pct,
                   round(a.percentage - b.percentage, 9) AS pct_diff
            FROM (SELECT * FROM s WHERE dataset_name = 'F') a
            JOIN (SELECT * FROM s WHERE dataset_name = 'P') b USING (section)
            ORDER BY abs(a.percentage - b.percentage) DESC, section LIMIT 15"""),
        "yearmonth_counts": w(["dates"], """
            SELECT dataset_name, make_date(year, month, 1) AS yearmonth, count(year) AS year,
                   count(month) AS month, count(section) AS section FROM dates GROUP BY 1, 2"""),
        "year_density": w(["dates"], """
            , d AS (SELECT dataset_name, year::DOUBLE AS y FROM dates WHERE year > 1960),
            b AS (SELECT dataset_name, count(*)::DOUBLE AS n, min(y) AS lo, max(y) AS hi,
                         stddev_samp(y) * pow(count(*), -0.2::DOUBLE) AS h FROM d GROUP BY 1),
            g AS (SELECT *, lo - 3 * h + (hi - lo + 6 * h) * k / 199 AS x
                  FROM b, range(200) t(k)),
            m AS (SELECT dataset_name, y, count(*) AS m FROM d GROUP BY 1, 2)
            SELECT dataset_name, CAST(k AS INT) AS point, round(x, 7) AS year,
                   round(sum(m * exp(-0.5 * pow((x - y) / h, 2))) / (n * h * sqrt(2 * pi()))
                         * n / (SELECT count(*) FROM d), 7) AS density
            FROM g JOIN m USING (dataset_name) GROUP BY dataset_name, k, x, n, h"""),
        "manifest_filter": w(["manifest"], """
            SELECT * FROM manifest WHERE (path LIKE 'data/c4/%' OR path LIKE 'data/cc\\_news/%'
                   ESCAPE '\\') AND path LIKE '%.json.gz' AND path NOT LIKE '%/src1/%'"""),
        "manifest_by_rule": w(["manifest"], f"""
            , rules AS (SELECT * FROM (VALUES {_rule_values()}) r(output, suffix, prefixes, excludes)),
            met AS (SELECT output, size FROM rules, manifest
                    WHERE ends_with(path, suffix)
                      AND (len(prefixes) = 0
                           OR len(list_filter(prefixes, lambda p: starts_with(path, p))) > 0)
                      AND len(list_filter(excludes, lambda x: contains(path, x))) = 0)
            SELECT r.output, r.suffix, count(m.output) AS n_files,
                   CAST(coalesce(sum(m.size), 0) AS BIGINT) AS bytes
            FROM rules r LEFT JOIN met m USING (output) GROUP BY 1, 2"""),
        "manifest_grep": w(["manifest"], """
            SELECT dataset_name, path, split_part(path, '/', -1) AS file_name FROM manifest
            WHERE regexp_matches(path, '/c4|/cc_|/falcon-refinedweb')"""),
        "chunk_lines": w(["manifest"], """
            SELECT dataset_name, path, rn AS line_number, CAST((rn - 1) // 100 + 1 AS INT) AS batch
            FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY path) AS rn
                  FROM manifest)"""),
        "size_batches": w(["batched"], "SELECT * FROM batched"),
        "batch_lists": w(["batched"], "SELECT * FROM batched"),
        "batch_stats": w(["batched"], """
            SELECT dataset_name, batch, count(*) AS n_files, round(sum(size) / 1e9, 9) AS gb
            FROM batched GROUP BY 1, 2"""),
        "batch_totals": w(["batched"], """
            SELECT dataset_name, round(sum(s) / 1e9, 9) AS total_gb, count(*) AS n_batches,
                   round(sum(s) / 1e9 / count(*), 9) AS mean_gb
            FROM (SELECT dataset_name, batch, sum(size) AS s FROM batched GROUP BY 1, 2)
            GROUP BY 1"""),
        "batch_exists": w(["batched"], """
            SELECT dataset_name, max(batch = 3) AS batch_exists FROM batched GROUP BY 1"""),
        "sample_scan": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100",
        "sketched_distinct_hosts": w(["hosts"], """
            SELECT dataset_name, count(DISTINCT url_host_name) AS n_hosts, true AS in_range FROM hosts GROUP BY 1
            UNION ALL SELECT 'all', count(DISTINCT url_host_name), true FROM hosts"""),
        "streamed_totals": w(["urls"], "SELECT 'pages' AS dataset_name, domain, "
                             "count(*) AS url_count FROM urls GROUP BY 2"),
        "family_edges": w(["pairs"], f"""
            , edges AS (
              SELECT DISTINCT CASE WHEN contains(s, '/CC') THEN 'Common Crawl' ELSE split_part(s, '/', -1) END AS source,
                     split_part(targets[1], '/', -1) AS target FROM (SELECT targets, unnest(sources) AS s FROM pairs)),
            drawn(source, target) AS (VALUES {_drawn()})
            SELECT source, target, source IN (SELECT lower(replace(source, ' ', '-')) FROM edges) AS in_pairs FROM drawn
            UNION ALL SELECT source, target, true FROM edges"""),
        "next_batch": w(["batched"], """
            SELECT dataset_name, min(batch) AS batch FROM batched b
            WHERE NOT EXISTS (SELECT 1 FROM batched d WHERE d.dataset_name = b.dataset_name
                              AND d.batch = b.batch AND d.size > 10000) GROUP BY 1"""),
        "requested_batch": w(["batched"], "SELECT * FROM batched WHERE batch = 2"),
        "size_tally": """
            SELECT median(n_chars)::DOUBLE AS median_size, CAST(sum(n_chars) AS BIGINT)
                   AS total_size FROM documents""",
        "pending_work": "SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS "
                        "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "dedupe_first": w(["listings"], _CARDS),
        "mark_collected": w(["listings"], f"""
            SELECT id, id IN (SELECT source || '/' || lang || '-' || n_chars
                              FROM documents JOIN labels USING (doc_id)) AS readme_collected
            FROM ({_CARDS})"""),
        "distinct_readmes": "SELECT source, md5(text) AS text_md5 FROM "
                            "(SELECT DISTINCT source, text FROM documents WHERE text <> '')",
        "distinct_links": "SELECT DISTINCT 'https://huggingface.co/datasets/hub/' || source "
                          "AS dataset_url FROM documents WHERE lang IS NOT NULL",
        "registry_parts": """
            SELECT url, creator, title,
                   '| [' || title || '](' || url || ') | ' || creator || ' |' AS markdown
            FROM (SELECT DISTINCT 'https://huggingface.co/datasets/' || lang || '/' || source
                         AS url, lang AS creator, source AS title FROM documents)""",
        "text_mentions": w(["mentions"], """
            , ids AS (SELECT doc_id, term_id::VARCHAR AS t FROM mentions UNION
                      SELECT doc_id, 'commoncrawl' FROM documents WHERE regexp_matches(
                      lower(text), 'cc-main|common crawl|commoncrawl'))
            SELECT d.doc_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS mentioned
            FROM documents d LEFT JOIN ids USING (doc_id) GROUP BY 1"""),
        "text_mentions_anchored": w(["mentions"], "SELECT doc_id, term_id FROM mentions"),
        "mention_flag": "SELECT doc_id, regexp_matches(lower(text), "
                        "'cc-main|common crawl|commoncrawl') AS mentioned_cc FROM documents",
        "mentions_depth1": w(["mentions"], """
            SELECT DISTINCT doc_id FROM mentions
            WHERE term_id IN (SELECT doc_id FROM labels WHERE quality = 1)
              AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
              AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""),
        "label_metrics": w(["scored"], _metrics("long", "is_long") + " UNION ALL "
                           + _metrics("clean", "is_clean")),
        "flag_counts": """
            SELECT has_label, count(*) AS n,
                   round(count(*)::DOUBLE / (SELECT count(*) FROM documents) * 100, 9) AS pct
            FROM (SELECT l.doc_id IS NOT NULL AS has_label FROM documents d
                  LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1""",
        "parse_label_response": """
            SELECT page_id, CASE WHEN ok THEN url END AS url,
                   CASE WHEN ok THEN NOT contains(url, '//blog.') END AS is_news,
                   CASE WHEN ok THEN 'by host' END AS reason
            FROM (SELECT *, url LIKE 'https://%' AS ok FROM pages)""",
        "shuffled_take": w(["skewed_all"], """
            SELECT * FROM skewed_all ORDER BY md5('42|' || domain), domain LIMIT 100"""),
        "stratified_sample": w(["skewed_all"], f"""
            SELECT domain, url_count, bucket FROM (
              SELECT *, row_number() OVER (PARTITION BY bucket
                                           ORDER BY md5('42|' || domain), domain) AS rn
              FROM (SELECT *, {_CUT_CASE} AS bucket FROM skewed_all)) WHERE rn <= 5"""),
        "streamed_domain_counts": w(["urls"], "SELECT 'pages' AS dataset_name, domain, "
                                    "count(*) AS url_count FROM urls GROUP BY 2"),
    }
