"""The named queries. Each takes a session and the folder of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprov.functions.domains import host_to_domain, register_domain_functions, with_host
from corpusprov.functions.names import clean_name, output_name, pair_key
from corpusprov.functions.urls import dict_text_url, json_url
from corpusprov.operators import clusters as clu
from corpusprov.operators import concentration as conc
from corpusprov.operators import counts as cnt
from corpusprov.operators import divergence as div
from corpusprov.operators import facets as fac
from corpusprov.operators import labels as lab
from corpusprov.operators import lineage as lin
from corpusprov.operators import manifest as man
from corpusprov.operators import mentions as men
from corpusprov.operators import sampling as sam
from corpusprov.operators import timeline as tim
from corpusprov.operators.ordering import shared_folder
from corpusprov.plans import inputs as fx
from corpusprov.sources import tables as tab
from corpusprov.sources.readers import sample_rows, url_columns
from corpusprov.sources.rules import extract_urls, find_rule, rules_frame
from corpusprov.streaming import current_totals, ingest_counts, ingest_totals, running_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BATCH_TARGET = 100_000
THRESHOLDS = [10, 100, 500, 1000, 10000, 100000]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# URLs and their fields


@query
def scan_parquet_urls(spark, sf):
    return fx.table(spark, sf, "pages").select("url").where(F.col("url").isNotNull())


@query
def url_domain_table(spark, sf):
    return extract_urls(fx.table(spark, sf, "pages"), "url", fx.SUFFIXES)


@query
def extract_domain_sql(spark, sf):
    register_domain_functions(spark, fx.SUFFIXES)
    return fx.line_urls(spark, sf).select(
        "url", F.expr("url_host(url)").alias("host"), F.expr("extract_domain(url)").alias("domain"))


@query
def dataset_slice(spark, sf):
    return tab.dataset_slice(fx.urls(spark, sf), ["pages_de", "pages_fr"]).select(
        "dataset_name", "url", "domain")


@query
def like_urls(spark, sf):
    return fx.line_urls(spark, sf).where(F.col("url").like("%.s1.co.uk%")).select("url")


@query
def crawl_index_host_urls(spark, sf):
    return tab.host_urls(fx.crawl_index(spark, sf), "CC-MAIN-1998-13", "www.s1.com")


@query
def url_from_struct(spark, sf):
    rule = find_rule("eduagarcia/crawlpt_dedup")
    return fx.raw_struct(spark, sf).select("page_id", F.expr(rule.url_sql()).alias("url"))


@query
def url_from_json(spark, sf):
    return fx.raw_json(spark, sf).select("page_id", json_url("general_metadata").alias("url"))


@query
def url_from_dict_text(spark, sf):
    return fx.raw_dict(spark, sf).select(
        "page_id", dict_text_url("source_other").alias("url"),
        dict_text_url("source_other", strict_parity=True).alias("url_text"))


@query
def domain_lookup(spark, sf):
    return cnt.domain_counts(fx.lines(spark, sf)).where(F.col("domain") == "s1.co.uk")


@query
def path_facets(spark, sf):
    return fx.facets(spark, sf).select("url", "year", "section")


@query
def url_column_scan(spark, sf):
    out = None
    for name in ("pages", "documents", "events"):
        one = url_columns(fx.table(spark, sf, name), name)
        out = one if out is None else out.unionByName(one)
    return out


# Counts and shares


@query
def domain_counts(spark, sf):
    return cnt.domain_counts(fx.urls(spark, sf), ["dataset_name"])


@query
def domain_counts_lines(spark, sf):
    return cnt.domain_counts(fx.lines(spark, sf), ["dataset_name"])


@query
def domain_counts_unified(spark, sf):
    crawls = host_to_domain(fx.hosts(spark, sf), "url_host_name", rules=fx.SUFFIXES)
    crawls = crawls.drop("url_host_name").withColumnRenamed("domain", "url_host_name")
    return cnt.unify_counts(fx.lines(spark, sf), crawls)


@query
def host_counts_merged(spark, sf):
    return cnt.merge_counts(fx.hosts(spark, sf))


@query
def combined_host_counts(spark, sf):
    hosts = fx.hosts(spark, sf)
    first, second = (hosts.where(F.col("crawl").startswith(p)) for p in ("CC-MAIN", "CC_MAIN"))
    combined = cnt.combine_snapshots([first, second])
    return combined.orderBy(F.desc("total_count"), "url_host_name").limit(20)


@query
def domain_share(spark, sf):
    share = cnt.with_share(fx.skewed_all(spark, sf), name="percentage")
    return rounded(share, "percentage").orderBy(F.desc("url_count"), "domain")


@query
def top_domains(spark, sf):
    return rounded(cnt.top_domains(fx.skewed_all(spark, sf)), "pct_urls")


@query
def top10_share(spark, sf):
    return rounded(cnt.top_share(fx.skewed_all(spark, sf)), "top_share")


@query
def top10_vs_median(spark, sf):
    out = cnt.top_vs_median(fx.skewed_all(spark, sf))
    return rounded(rounded(out, "med_pct"), "ratio", places=6)


@query
def threshold_counts(spark, sf):
    return cnt.threshold_counts(fx.skewed_all(spark, sf), THRESHOLDS)


@query
def threshold_and_match(spark, sf):
    # The dot of the pattern stands for any character, as in the analysis this repeats.
    out = cnt.match_fraction(cnt.domain_counts(fx.lines(spark, sf)),
                             F.col("domain").rlike("s1.co.uk"), "url_count")
    return rounded(out, "ratio")


@query
def match_fraction_rows(spark, sf):
    out = cnt.match_fraction(fx.urls(spark, sf), F.col("url").like("%blog.%"))
    return rounded(out, "ratio")


@query
def match_fraction_counts(spark, sf):
    out = cnt.match_fraction(fx.hosts(spark, sf), F.col("url_host_name").like("%s1.com%"),
                             "url_count")
    return rounded(out, "ratio")


@query
def corpus_ratio(spark, sf):
    return rounded(cnt.corpus_ratio(fx.urls(spark, sf), fx.hosts(spark, sf)), "ratio")


@query
def snapshot_totals(spark, sf):
    return cnt.snapshot_totals(fx.hosts(spark, sf))


@query
def distinct_domains(spark, sf):
    return cnt.distinct_domains(fx.hosts(spark, sf))


@query
def snapshot_stats(spark, sf):
    return cnt.snapshot_stats(fx.hosts(spark, sf))


@query
def snapshot_timeline(spark, sf):
    return tim.snapshot_timeline(cnt.snapshot_totals(fx.hosts(spark, sf)))


@query
def language_share(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return rounded(cnt.group_share(docs, "source", "lang"), "share")


@query
def source_share(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return rounded(cnt.group_share(docs, "lang", "source"), "share")


@query
def table_shape(spark, sf):
    out = None
    for name in ("pages", "documents", "events", "lineitem", "orders"):
        one = conc.table_shape(fx.table(spark, sf, name)).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# Divergence


def _domain_level(spark, sf):
    return domain_counts_unified(spark, sf)


def _host_level(spark, sf, merge=True):
    by_host = with_host(fx.line_urls(spark, sf), host="domain")
    return cnt.unify_counts(by_host, fx.hosts(spark, sf), merge)


@query
def kl_divergence(spark, sf):
    """All crawl snapshots against one derived corpus, by registered domain."""
    counts = _domain_level(spark, sf)
    name = F.col("dataset_name")
    crawls = counts.where(name.startswith("CC")).select("domain", "url_count")
    out = div.kl_divergence(crawls, counts.where(name == "lines_o"))
    return rounded(out, "kl_divergence")


@query
def kl_divergence_hosts(spark, sf):
    """Pages in English against the other pages, by host."""
    counts = cnt.domain_counts(fx.urls(spark, sf), ["dataset_name"], "host")
    english = F.col("dataset_name") == "pages_en"
    out = div.kl_divergence(counts.where(english), counts.where(~english), key="host")
    return rounded(out, "kl_divergence")


@query
def kl_all_pairs(spark, sf):
    out = div.kl_all_pairs(_domain_level(spark, sf), fx.pairs(spark, sf), known=fx.dataset_names(spark, sf))
    return rounded(out.drop("pair_id"), "kl_divergence")


@query
def kl_all_pairs_hosts(spark, sf):
    out = div.kl_all_pairs(_host_level(spark, sf), fx.pairs(spark, sf), known=fx.dataset_names(spark, sf))
    return rounded(out.drop("pair_id"), "kl_divergence")


@query
def kl_all_pairs_unmerged(spark, sf):
    counts = _host_level(spark, sf, merge=False)
    out = div.kl_all_pairs(counts, fx.pairs(spark, sf), merge=False, known=fx.dataset_names(spark, sf))
    return rounded(out.drop("pair_id"), "kl_divergence", places=6)


@query
def pair_keys(spark, sf):
    return fx.pairs(spark, sf).select(pair_key("sources", "targets").alias("pair_key"))


@query
def lineage_edges(spark, sf):
    return lin.lineage_edges(fx.pairs(spark, sf))


@query
def clean_names(spark, sf):
    names = fx.hosts(spark, sf).select("dataset_name").distinct()
    full = F.concat(F.lit("hub/"), F.col("dataset_name"), F.lit(".v1"))
    return names.select(
        clean_name(full).alias("clean"),
        output_name(full, F.lit("default")).alias("output"),
        output_name(full, F.lit("noisy")).alias("output_noisy"))


# Concentration


@query
def gini(spark, sf):
    return rounded(conc.gini(fx.skewed_all(spark, sf)), "gini")


@query
def gini_by_dataset(spark, sf):
    return rounded(conc.gini(fx.skewed(spark, sf), ["dataset_name"]), "gini")


@query
def lorenz_curve(spark, sf):
    curve = conc.lorenz_curve(fx.skewed(spark, sf), ["dataset_name"])
    return rounded(curve, "pct_domains", "pct_urls", places=7)


@query
def top_share_pct(spark, sf):
    out = conc.top_share_pct(fx.skewed(spark, sf), ["dataset_name"])
    return rounded(out, "top_1_pct", "top_10_pct", places=7)


@query
def size_bucket_pct(spark, sf):
    out = conc.size_bucket_pct(fx.skewed(spark, sf), ["dataset_name"])
    return rounded(out, "pct_domains")


@query
def log_histogram(spark, sf):
    return rounded(conc.log_histogram(fx.skewed_all(spark, sf)), "low", "high", places=6)


@query
def count_summary(spark, sf):
    return rounded(conc.count_summary(fx.skewed(spark, sf), ["dataset_name"]), "mean_urls")


@query
def cut_bucket_counts(spark, sf):
    return conc.cut_bucket_counts(fx.skewed_all(spark, sf))


@query
def cluster_ranges(spark, sf):
    return clu.cluster_ranges(fx.skewed_all(spark, sf))


@query
def cluster_choice(spark, sf):
    return rounded(clu.silhouettes(fx.skewed_all(spark, sf)), "silhouette", places=6)


# Sections and years


@query
def section_share(spark, sf):
    return rounded(fac.section_share(fx.facets(spark, sf)), "share")


@query
def section_share_delta(spark, sf):
    facets = fx.facets(spark, sf)
    parent, child = (facets.where(F.col("dataset_name") == n) for n in ("lines_f", "lines_o"))
    out = fac.section_share_delta(parent, child)
    return rounded(out, "parent_share", "child_share", "delta")


@query
def section_pct_by_dataset(spark, sf):
    return rounded(fac.section_pct(fx.dates(spark, sf)), "percentage")


@query
def top_sections(spark, sf):
    pct = rounded(fac.section_pct(fx.facets(spark, sf)), "percentage")
    return fac.top_sections(pct, 3)


@query
def common_sections(spark, sf):
    return fac.common_sections(fac.section_pct(fx.dates(spark, sf)), "F", "P")


@query
def common_section_delta(spark, sf):
    out = fac.common_section_delta(fac.section_pct(fx.dates(spark, sf)), "F", "P")
    return rounded(out, "first_pct", "second_pct", "pct_diff")


@query
def yearmonth_counts(spark, sf):
    return fac.yearmonth_counts(fx.dates(spark, sf))


@query
def year_density(spark, sf):
    return rounded(fac.year_density(fx.dates(spark, sf)), "year", "density", places=7)


# Manifests and work lists


@query
def manifest_filter(spark, sf):
    keep = man.rule_filter("path", ["data/c4/", "data/cc_news/"], ".json.gz", ["/src1/"])
    return fx.manifest(spark, sf).where(keep)


@query
def manifest_by_rule(spark, sf):
    """Files of the whole manifest that each extraction rule would read."""
    found = man.files_by_rule(fx.manifest(spark, sf), rules_frame(spark))
    return found.select("output", "suffix", "n_files", "bytes")


@query
def manifest_grep(spark, sf):
    paths = fx.manifest(spark, sf).select("dataset_name", "path")
    return man.path_lines(paths, "path", man.PATH_MARKS)


@query
def chunk_lines(spark, sf):
    paths = fx.manifest(spark, sf).select("dataset_name", "path")
    return man.chunk_lines(paths, ["dataset_name"], ["path"])


def _batched(spark, sf):
    return man.size_batches(fx.manifest(spark, sf), ["dataset_name"], BATCH_TARGET)


@query
def size_batches(spark, sf):
    return _batched(spark, sf)


@query
def batch_stats(spark, sf):
    return rounded(man.batch_stats(_batched(spark, sf), ["dataset_name"]), "gb")


@query
def batch_totals(spark, sf):
    out = man.batch_totals(_batched(spark, sf), ["dataset_name"])
    return rounded(out, "total_gb", "mean_gb")


@query
def next_batch(spark, sf):
    """First batch with a file that is not done; a whole batch is done at once here."""
    batched = _batched(spark, sf)
    done = batched.where(F.col("size") > 10_000).select("dataset_name", "batch").distinct()
    return man.next_batch(batched, done, ["dataset_name"])


@query
def requested_batch(spark, sf):
    return man.requested_batch(_batched(spark, sf), 2)


@query
def size_tally(spark, sf):
    return man.size_tally(fx.manifest(spark, sf))


@query
def pending_work(spark, sf):
    return man.pending(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"), ["doc_id"])


# Cards, mentions and labels


@query
def dedupe_first(spark, sf):
    return lin.card_table(fx.cards(spark, sf))


@query
def mark_collected(spark, sf):
    cards = lin.card_table(fx.cards(spark, sf))
    docs = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id")
    done = docs.select(F.concat("source", F.lit("/"), "lang", F.lit("-"),
                                F.col("n_chars").cast("string")).alias("id"))
    return lin.mark_collected(cards, done).select("id", "readme_collected")


@query
def distinct_readmes(spark, sf):
    docs = fx.table(spark, sf, "documents").select("source", "text")
    return docs.where(F.col("text") != "").select("source", F.md5("text").alias("text_md5")).distinct()


@query
def distinct_links(spark, sf):
    used = fx.table(spark, sf, "documents").groupBy(F.col("source").alias("dataset")).agg(
        F.collect_set("lang").alias("models"))
    return lin.model_links(used.withColumn("dataset", F.concat(F.lit("hub/"), "dataset")))


@query
def registry_parts(spark, sf):
    ids = fx.table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("id"))
    return lin.registry_parts(ids.distinct().select(lin.dataset_url("id").alias("url")))


def _mentions(spark, sf):
    return men.find_mentions(fx.table(spark, sf, "documents"), fx.table(spark, sf, "benchmark"),
                             "doc_id", "text", "item_id", "text")


@query
def text_mentions(spark, sf):
    terms = men.with_crawl_terms(fx.table(spark, sf, "benchmark"), "item_id", "text")
    out = men.mention_lists(fx.table(spark, sf, "documents"), terms,
                            "doc_id", "text", "item_id", "text")
    return out.withColumn("mentioned", F.array_join("mentioned", ","))


@query
def text_mentions_anchored(spark, sf):
    """The same mentions as rows."""
    return _mentions(spark, sf)


@query
def mention_flag(spark, sf):
    docs = fx.table(spark, sf, "documents")
    flagged = docs.select("doc_id", men.mention_flag("text").alias("mentioned_cc"))
    return flagged


@query
def mentions_depth1(spark, sf):
    labels = fx.table(spark, sf, "labels")
    wanted = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    toxic = labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return men.mentions_depth1(_mentions(spark, sf), wanted, [toxic], "doc_id")


@query
def label_metrics(spark, sf):
    out = lab.label_metrics(fx.scored(spark, sf), "quality",
                            {"long": "is_long", "clean": "is_clean"})
    return rounded(out, "accuracy", "precision", "recall", "f1")


@query
def flag_counts(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    labelled = fx.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has_label"))
    flags = docs.join(labelled, "doc_id", "left").na.fill(False, ["has_label"])
    return rounded(lab.flag_counts(flags, "has_label"), "pct")


@query
def parse_label_response(spark, sf):
    parsed = fx.responses(spark, sf).select("page_id", lab.parse_response("response").alias("r"))
    return parsed.select("page_id", "r.url", "r.is_news", "r.reason")


# Samples and streams


@query
def shuffled_take(spark, sf):
    return sam.take_shuffled(fx.skewed_all(spark, sf), 100, ["domain"], digest=True)


@query
def stratified_sample(spark, sf):
    counts = fx.skewed_all(spark, sf).withColumn("bucket", conc.cut_bucket())
    return sam.stratified_sample(counts, "bucket", 5, ["domain"], digest=True)


@query
def streamed_domain_counts(spark, sf):
    """Pages taken in by the file stream, counted batch by batch, then added up."""
    folder = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    ingest_counts(spark, f"{sf}/page[s].parquet", f"{folder}/counts", f"{folder}/checkpoint",
                  fx.table(spark, sf, "pages").schema, "pages", fx.SUFFIXES)
    return running_counts(spark, f"{folder}/counts")


@query
def streamed_totals(spark, sf):
    """The same by totals that the stream keeps in its state."""
    folder = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"
    ingest_totals(spark, f"{sf}/page[s].parquet", f"{folder}/totals", f"{folder}/checkpoint",
                  fx.table(spark, sf, "pages").schema, "pages", fx.SUFFIXES)
    return current_totals(spark, f"{folder}/totals")


@query
def sketched_distinct_hosts(spark, sf):
    """Hosts of each snapshot and of all: exact, and whether the sketches' range holds it."""
    hosts = fx.hosts(spark, sf)
    sketches = cnt.distinct_sketches(hosts, ["dataset_name"])
    every = cnt.distinct_of_sketches(sketches).withColumn("dataset_name", F.lit("all"))
    ranges = cnt.distinct_of_sketches(sketches, ["dataset_name"]).unionByName(every)
    exact = hosts.groupBy("dataset_name").agg(F.count_distinct("url_host_name").alias("n_hosts")).unionByName(
        hosts.agg(F.count_distinct("url_host_name").alias("n_hosts")).withColumn("dataset_name", F.lit("all")))
    return exact.join(ranges, "dataset_name").select(
        "dataset_name", "n_hosts", F.col("n_hosts").between(F.col("low"), F.col("high")).alias("in_range"))


@query
def sample_scan(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return sample_rows(docs, 100, ["doc_id"])


@query
def batch_exists(spark, sf):
    return man.batch_exists(_batched(spark, sf), ["dataset_name"], 3)


@query
def family_edges(spark, sf):
    """The hand-drawn tree beside the edges of the pairs, and which of its nodes they name."""
    pairs = lin.lineage_edges(fx.pairs(spark, sf)).distinct()
    drawn = lin.family_edges(spark)
    named = pairs.select(F.lower(F.translate("source", " ", "-")).alias("source")).distinct()
    marked = drawn.join(named.withColumn("in_pairs", F.lit(True)), "source", "left").na.fill(False, ["in_pairs"])
    return marked.unionByName(pairs.withColumn("in_pairs", F.lit(True)))
