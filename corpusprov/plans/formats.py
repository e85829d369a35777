"""Named queries that pass whole tables through each format and writer, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusprov.operators import divergence as div
from corpusprov.operators.ordering import shared_folder
from corpusprov.plans import inputs as fx
from corpusprov.plans.queries import _batched, _domain_level, query, rounded
from corpusprov.sources.readers import list_files, read_corpus
from corpusprov.sources.rules import extract_urls
from corpusprov.sources.sinks import compact, csv_to_parquet, current_results, write_batches, write_csv, write_url_batch
from corpusprov.sources.tables import read_datasets
from corpusprov.streaming import ingest_urls


def _fresh(spark, name: str) -> str:
    """A folder below the shared one that nothing has written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def read_ndjson(spark, sf):
    """Conversations as compressed lines of JSON."""
    turns, path = fx.table(spark, sf, "conversations"), _fresh(spark, "ndjson")
    turns.write.option("compression", "gzip").json(path)
    return read_corpus(spark, path, ".json.gz", turns.schema)


@query
def read_csv(spark, sf):
    """Raw pages, with their quotes and line breaks, as CSV."""
    pages, path = fx.table(spark, sf, "pages"), _fresh(spark, "csv")
    write_csv(pages, path)
    return read_corpus(spark, path, ".csv", pages.schema)


@query
def csv_round_trip(spark, sf):
    """Documents as CSV, turned into Parquet."""
    docs, path = fx.table(spark, sf, "documents"), _fresh(spark, "documents")
    write_csv(docs, f"{path}/csv")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    csv_to_parquet(spark, f"{path}/csv", f"{path}/parquet", schema)
    return spark.read.parquet(f"{path}/parquet")


@query
def list_manifest(spark, sf):
    """Folders of a partitioned table, from the listing of its files."""
    path = _fresh(spark, "orders")
    fx.table(spark, sf, "orders").write.partitionBy("o_orderstatus").parquet(path)
    files = list_files(spark, path).where(F.col("path").endswith(".parquet"))
    folder = F.regexp_extract("path", "^o_orderstatus=([^/]+)/", 1)
    return files.groupBy(folder.alias("folder")).agg((F.min("size") > 0).alias("filled"))


@query
def compacted(spark, sf):
    """A URL table of two batches in fewer files; it keeps dataset, writer and batch."""
    urls, path = extract_urls(fx.table(spark, sf, "pages"), "url", fx.SUFFIXES), _fresh(spark, "urls")
    early = F.coalesce(F.col("domain") < "m", F.lit(False))
    write_url_batch(urls.where(early), f"{path}/batches", "pages", 1)
    write_url_batch(urls.where(~early), f"{path}/batches", "pages", 2)
    compact(spark, f"{path}/batches", f"{path}/compact", 2)
    schema = "url string, domain string, writer string, batch int, dataset_name string"
    return read_datasets(spark, f"{path}/compact", ["pages"], schema)


@query
def url_stream(spark, sf):
    """URLs of the pages, taken in by the file stream."""
    path = _fresh(spark, "url-stream")
    ingest_urls(spark, f"{sf}/page[s].parquet", f"{path}/urls", f"{path}/checkpoint",
                fx.table(spark, sf, "pages").schema, "pages", fx.SUFFIXES)
    return read_datasets(spark, f"{path}/urls", ["pages"]).select("url", "domain", "dataset_name")


@query
def batch_lists(spark, sf):
    """Batch lists as they are stored, one partition per batch."""
    batched, path = _batched(spark, sf), _fresh(spark, "batch-lists")
    write_batches(batched, path, ["dataset_name"])
    return spark.read.schema(batched.schema).parquet(path)


@query
def kl_resume(spark, sf):
    """The stored results after a run of some pairs, then one of all pairs."""
    counts, pairs, path = _domain_level(spark, sf), fx.pairs(spark, sf), _fresh(spark, "results")
    known = fx.dataset_names(spark, sf)
    div.update_results(counts, pairs.where(F.size("sources") > 1), path, known)
    div.update_results(counts, pairs, path, known)
    stored = current_results(spark, path, "pair_id", div.RESULT_SCHEMA)
    return rounded(stored.select("pair_key", "kl_divergence"), "kl_divergence")
