"""Counts of URLs per domain or host, shares, totals and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def domain_counts(urls: DataFrame, by: list[str] | None = None, domain: str = "domain") -> DataFrame:
    """URLs per domain (and per ``by``). A NULL domain is a group of its own."""
    return urls.groupBy(*(by or []), domain).agg(F.count(F.lit(1)).alias("url_count"))


def merge_counts(
    hosts: DataFrame, key: str = "url_host_name", by: list[str] | None = None,
    value: str = "url_count", out: str = "url_count",
) -> DataFrame:
    """Sum partial counts, for example of one host over many crawls."""
    return hosts.groupBy(*(by or []), key).agg(F.sum(F.col(value).cast("bigint")).alias(out))


def combine_snapshots(tables: list[DataFrame], key: str = "url_host_name") -> DataFrame:
    """One count per host over all snapshots, as ``total_count``."""
    rows = reduce(DataFrame.unionByName, [t.select(key, "url_count") for t in tables])
    return merge_counts(rows, key, out="total_count")


def unify_counts(urls: DataFrame | None, hosts: DataFrame | None, merge: bool = True) -> DataFrame:
    """Bring both kinds of table into one ``(dataset_name, domain, url_count)`` form.

    URL tables are counted; host-count tables are summed, or kept row by row with
    ``merge=False``. Which kind a dataset is then no longer matters.
    """
    parts = []
    if urls is not None:
        parts.append(domain_counts(urls, ["dataset_name"]))
    if hosts is not None:
        rows = hosts.select(
            "dataset_name",
            F.col("url_host_name").alias("domain"),
            F.col("url_count").cast("bigint").alias("url_count"),
        )
        parts.append(merge_counts(rows, "domain", ["dataset_name"]) if merge else rows)
    return reduce(DataFrame.unionByName, parts)


def total(counts: DataFrame, value: str = "url_count") -> Column:
    """Sum of a column as a scalar subquery: computed once, no window and no join."""
    return counts.agg(F.sum(value).alias("total")).scalar()


def with_share(counts: DataFrame, value: str = "url_count", name: str = "share",
               scale: float = 1.0) -> DataFrame:
    share = F.col(value).cast("double") / total(counts, value).cast("double")
    return counts.withColumn(name, share * scale if scale != 1.0 else share)


def top_domains(counts: DataFrame, n: int = 10, key: str = "domain",
                value: str = "url_count") -> DataFrame:
    """The n largest domains with their percentage; equal counts go by name."""
    ranked = with_share(counts, value, "pct_urls", 100.0)
    return ranked.orderBy(F.desc(value), F.asc_nulls_first(key)).limit(n)


def top_share(counts: DataFrame, n: int = 10, key: str = "domain",
              value: str = "url_count") -> DataFrame:
    """Share of all URLs in the n largest domains, and the median count among them."""
    top = counts.orderBy(F.desc(value), F.asc_nulls_first(key)).limit(n)
    return top.agg(
        (F.sum(value).cast("double") / total(counts, value).cast("double")).alias("top_share"),
        F.median(value).alias("median_count"),
    )


def median_count(counts: DataFrame, value: str = "url_count") -> DataFrame:
    """Exact median from the histogram of counts, which stays small."""
    hist = counts.groupBy(value).agg(F.count(F.lit(1)).alias("m"))
    return hist.agg(F.expr(f"percentile(`{value}`, 0.5, m)").alias("med_cnt"))


def top_vs_median(counts: DataFrame, n: int = 10, key: str = "domain",
                  value: str = "url_count") -> DataFrame:
    """Median share, median count, and the top-n share divided by the median share."""
    all_urls = total(counts, value).cast("double")
    top = top_share(counts, n, key, value).select("top_share").scalar()
    med = median_count(counts, value).withColumn("med_pct", F.col("med_cnt") / all_urls)
    return med.select("med_pct", "med_cnt", (top / F.col("med_pct")).alias("ratio"))


def threshold_counts(counts: DataFrame, thresholds: list[int], value: str = "url_count") -> DataFrame:
    """Domains with at least each threshold of URLs, in one pass."""
    sums = [F.count(F.when(F.col(value) >= t, 1)).alias(f"t{t}") for t in thresholds]
    one = counts.agg(*sums)
    pairs = [F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"t{t}").alias("n_domains"))
             for t in thresholds]
    return one.select(F.inline(F.array(*pairs)))


def match_fraction(df: DataFrame, condition: Column, weight: str | None = None) -> DataFrame:
    """Matching and total rows (or summed weights) and their ratio, in one pass."""
    if weight:
        hit, every = F.sum(F.when(condition, F.col(weight))), F.sum(weight)
    else:
        hit, every = F.count(F.when(condition, 1)), F.count(F.lit(1))
    one = df.agg(hit.alias("matching"), every.alias("total"))
    return one.withColumn("ratio", F.col("matching").cast("double") / F.col("total"))


def corpus_ratio(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows of a corpus against the URLs of the crawl it came from."""
    rows = urls.agg(F.count(F.lit(1)).alias("corpus_total"))
    one = rows.withColumn("crawl_total", total(hosts))
    return one.withColumn("ratio", F.col("corpus_total").cast("double") / F.col("crawl_total"))


def snapshot_totals(hosts: DataFrame, by: str = "dataset_name") -> DataFrame:
    return hosts.groupBy(by).agg(F.sum("url_count").alias("total_urls"))


def distinct_domains(hosts: DataFrame, key: str = "url_host_name") -> DataFrame:
    """Every host that any snapshot has, once."""
    return hosts.select(key).distinct()


def snapshot_stats(hosts: DataFrame, by: str = "dataset_name", key: str = "url_host_name",
                   value: str = "url_count") -> DataFrame:
    """Hosts, URLs and quartiles of the counts per snapshot.

    Quartiles come from the histogram of counts. Positive counts with sum T have at most
    sqrt(2T) different values, so a snapshot's histogram fits in one task.
    """
    hist = hosts.where(F.col(value).isNotNull()).groupBy(by, value).agg(
        F.count(F.lit(1)).alias("m"))
    stats = hist.groupBy(by).agg(
        F.sum(F.col(value) * F.col("m")).alias("total_urls"),
        F.expr(f"percentile(`{value}`, array(0.25D, 0.5D, 0.75D), m)").alias("_q"),
    )
    n_hosts = hosts.groupBy(by).agg(F.count_distinct(key).alias("total_hosts"))
    return n_hosts.join(stats, by, "left").select(
        by, "total_hosts", "total_urls",
        F.col("_q")[1].alias("median_urls"),
        F.col("_q")[0].alias("urls_25th"),
        F.col("_q")[2].alias("urls_75th"),
    )


def group_share(df: DataFrame, group: str, item: str, out: str = "share") -> DataFrame:
    """Rows per item and their share of the rows of the group."""
    items = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    totals = items.groupBy(F.col(group).alias("_g")).agg(F.sum("n").alias("_total"))
    joined = items.join(totals, F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(group, item, "n", (F.col("n").cast("double") / F.col("_total")).alias(out))


#: Registers of a distinct sketch, as a power of two; its standard error is SKETCH_ERROR.
SKETCH_LOG = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LOG / 2)


def distinct_sketches(rows: DataFrame, by: list[str], key: str = "url_host_name") -> DataFrame:
    """``(by..., sketch)``: what it takes to count distinct keys of any union later.

    A sketch has a fixed size however many keys went in, so sketches of snapshots can be stored
    and a new snapshot reads nothing old. NULL keys don't count.
    """
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(key), F.lit(SKETCH_LOG)).alias("sketch"))


def distinct_of_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., estimate, low, high)`` of the union of the sketches of each group.

    ``low`` and ``high`` are three standard errors away, which holds in 997 of 1000 cases.
    """
    union = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    found = sketches.groupBy(*(by or [])).agg(union.alias("estimate"))
    e = F.col("estimate")
    return found.withColumns({
        "low": F.floor(e * (1 - 3 * SKETCH_ERROR)), "high": F.ceil(e * (1 + 3 * SKETCH_ERROR))})
