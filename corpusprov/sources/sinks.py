"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusprov.sources.readers import read_corpus


def write_url_batch(urls: DataFrame, root: str, dataset_name: str, batch: int,
                    compression: str = "zstd", writer: str = "lists") -> None:
    """Write one batch of a dataset; writing the same batch again replaces it.

    ``writer`` names who numbers the batches, so that batches of two writers, such as two
    streams into one dataset, can't replace each other.
    """
    rows = urls.withColumns({
        "dataset_name": F.lit(dataset_name), "writer": F.lit(writer), "batch": F.lit(batch)})
    (rows.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .option("compression", compression)
     .partitionBy("dataset_name", "writer", "batch")
     .parquet(root))


def write_batches(batched: DataFrame, path: str, by: list[str]) -> None:
    """Store batch lists, one partition per group and batch, so that one batch reads alone.

    Rows of a batch meet before they are written, so there is about one file for each batch
    however many tasks there are; adaptive execution splits a batch that is too large for one
    task, such as that of the files of unknown size.
    """
    met = batched.hint("rebalance", *by, "batch")
    met.write.mode("overwrite").partitionBy(*by, "batch").parquet(path)


def compact(spark: SparkSession, source: str, target: str, files: int,
            compression: str = "zstd") -> None:
    """Rewrite many small files as ``files`` even ones.

    A URL table keeps its ``dataset_name`` partitions, each in up to ``files`` files, and the
    batch of a row as a column.
    """
    df = spark.read.parquet(source)
    by = [c for c in ("dataset_name",) if c in df.columns]
    writer = df.repartition(files).write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(target)


def write_csv(df: DataFrame, path: str) -> None:
    """White space at either end of a value is kept."""
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str) -> None:
    df = read_corpus(spark, source, ".csv", schema)
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored results, or none when nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def current_results(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Stored results, one row for each key: the first computed.

    Two runs at once can both store a key; files are only ever added, so neither loses rows
    of the other, and every reader takes the same one.
    """
    w = Window.partitionBy(key).orderBy("computed_at", F.xxhash64("*"))
    ranked = read_results(spark, path, schema).withColumn("_rank", F.row_number().over(w))
    return ranked.where("_rank = 1").drop("_rank")


def append_results(results: DataFrame, path: str, key: str, schema: str) -> None:
    """Add results whose key is not stored yet."""
    stored = read_results(results.sparkSession, path, schema).select(key)
    fresh = results.join(stored, key, "left_anti").withColumn("computed_at", F.current_timestamp())
    fresh.write.mode("append").parquet(path)
