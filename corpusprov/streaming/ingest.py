"""Each file once: URL tables and running counts from a folder that keeps growing.

The checkpoint remembers which files are done. Every batch writes into its own partition
and replaces it when it is run again, so a batch that fails half way leaves no double rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprov.functions.domains import SuffixRules, with_domain
from corpusprov.operators.counts import domain_counts
from corpusprov.operators.manifest import BATCH_BYTES
from corpusprov.sources.sinks import write_url_batch


def _file_stream(spark: SparkSession, source: str, schema, fmt: str, max_bytes: int) -> DataFrame:
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxBytesPerTrigger", max_bytes).load(source))


def _run(stream: DataFrame, each_batch, checkpoint: str) -> None:
    query = (stream.writeStream.foreachBatch(each_batch)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint; one that starts anew gets another."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def _urls(stream: DataFrame, url_sql: str, suffixes: SuffixRules) -> DataFrame:
    urls = stream.select(F.expr(url_sql).alias("url")).where(F.col("url").isNotNull())
    return with_domain(urls, rules=suffixes)


def ingest_urls(spark: SparkSession, source: str, target: str, checkpoint: str, schema,
                dataset_name: str, suffixes: SuffixRules, url_sql: str = "url", fmt: str = "parquet",
                max_bytes: int = BATCH_BYTES) -> None:
    """Extract (url, domain) of all new files, one ``batch=`` partition per batch."""
    urls = _urls(_file_stream(spark, source, schema, fmt, max_bytes), url_sql, suffixes)

    def save(batch: DataFrame, number: int) -> None:
        write_url_batch(batch.select("url", "domain"), target, dataset_name, number,
                        writer=_stream_id(spark, checkpoint))

    _run(urls, save, checkpoint)


def ingest_counts(spark: SparkSession, source: str, target: str, checkpoint: str, schema,
                  dataset_name: str, suffixes: SuffixRules, url_sql: str = "url", fmt: str = "parquet",
                  max_bytes: int = BATCH_BYTES) -> None:
    """Count the domains of all new files, one partition of partial counts per batch."""
    urls = _urls(_file_stream(spark, source, schema, fmt, max_bytes), url_sql, suffixes)

    def save(batch: DataFrame, number: int) -> None:
        write_url_batch(domain_counts(batch), target, dataset_name, number,
                        writer=_stream_id(spark, checkpoint))

    _run(urls, save, checkpoint)


def running_counts(spark: SparkSession, target: str) -> DataFrame:
    """Totals so far, from the partial counts of all batches."""
    schema = "domain string, url_count bigint, dataset_name string, writer string, batch bigint"
    parts = spark.read.schema(schema).parquet(target)
    return parts.groupBy("dataset_name", "domain").agg(F.sum("url_count").alias("url_count"))


def ingest_totals(spark: SparkSession, source: str, target: str, checkpoint: str, schema,
                  dataset_name: str, suffixes: SuffixRules, url_sql: str = "url", fmt: str = "parquet",
                  max_bytes: int = BATCH_BYTES) -> None:
    """Keep the running total of each domain in the stream's state.

    A batch reads its new files only, adds them to the state, and writes the totals that it
    changed as a partition of its own, which it replaces when it is run again. After a restart
    the state is that of the last batch that ended.
    """
    urls = _urls(_file_stream(spark, source, schema, fmt, max_bytes), url_sql, suffixes)

    def save(batch: DataFrame, number: int) -> None:
        write_url_batch(batch, target, dataset_name, number, writer=_stream_id(spark, checkpoint))

    query = (domain_counts(urls).writeStream.outputMode("update").foreachBatch(save)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def current_totals(spark: SparkSession, target: str) -> DataFrame:
    """The last total written of each domain, added up over streams."""
    schema = "domain string, url_count bigint, dataset_name string, writer string, batch bigint"
    parts = spark.read.schema(schema).parquet(target)
    last = parts.groupBy("dataset_name", "writer", "domain").agg(F.max_by("url_count", "batch").alias("url_count"))
    return last.groupBy("dataset_name", "domain").agg(F.sum("url_count").alias("url_count"))
