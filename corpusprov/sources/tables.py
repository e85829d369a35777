"""Dataset tables: one partition per dataset name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

URL_SCHEMA = "url string, domain string, dataset_name string"
HOST_SCHEMA = "crawl string, url_host_name string, url_count bigint, dataset_name string"


def read_datasets(spark: SparkSession, root: str, names: list[str], schema: str = URL_SCHEMA
                  ) -> DataFrame:
    """Rows of the named datasets under ``root``, from ``dataset_name=`` folders.

    Only the folders asked for are listed and read. A name without a folder is an error,
    not an empty dataset.
    """
    base = root.rstrip("/")
    folders = [f"{base}/dataset_name={name}" for name in names]
    reader = spark.read.schema(schema).option("basePath", base)
    try:
        return reader.parquet(*folders)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise ValueError(f"unknown dataset: {e}") from e


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """Union of tables with their name as ``dataset_name``."""
    parts = [df.withColumn("dataset_name", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def dataset_slice(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(F.col("dataset_name").isin(list(names)))


def host_urls(index: DataFrame, crawl: str, host: str) -> DataFrame:
    """URLs of one host in one crawl, without its home page and robots files."""
    home = [f"https://{host}", f"https://{host}/"]
    return index.where(
        (F.col("crawl") == crawl)
        & (F.col("url_host_name") == host)
        & ~F.col("url").isin(home)
        & ~F.col("url").like("%robots.txt")
    ).select("url")
