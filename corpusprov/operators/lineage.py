"""Which dataset descends from which, and tables of dataset cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprov.functions.names import fold_crawl_parent, last_part
from corpusprov.operators.ordering import top_n_per_group

# Fixed value: where a dataset id leads.
DATASET_URL = "https://huggingface.co/datasets/"
DATASET_URL_PARTS = r"datasets/([^/]+)/([^/]+)$"
# The hand-drawn family tree of corpora.
FAMILY_EDGES = """
common-crawl > oscar-family
oscar-family > cultura
oscar-family > oscar-other
common-crawl > c4-family
common-crawl > cultura
common-crawl > falcon
common-crawl > fineweb
fineweb > fineweb-edu
common-crawl > madlad-family
madlad-family > madlad-cleaned
madlad-family > madlad-noisy
common-crawl > zyda-2
c4-family > c4-en
c4-family > c4-multilingual
c4-family > c4-news
c4-family > c4-other
"""


def lineage_edges(pairs: DataFrame) -> DataFrame:
    """(source, target) edges of pairs; a pair's crawl parents are one source."""
    folded = F.array_distinct(F.transform("sources", lambda s: fold_crawl_parent(s)))
    target = last_part(F.get("targets", F.lit(0)))
    return pairs.select(F.explode(folded).alias("source"), target.alias("target"))


def family_edges(spark: SparkSession) -> DataFrame:
    """The hand-drawn tree in the form of ``lineage_edges``."""
    rows = [tuple(line.split(" > ")) for line in FAMILY_EDGES.strip().splitlines()]
    return spark.createDataFrame(rows, "source string, target string")


def dedupe_first(df: DataFrame, key: str, priority: list[Column]) -> DataFrame:
    """One row per key, the first by ``priority``."""
    return top_n_per_group(df, [key], priority, 1)


def card_table(listings: list[DataFrame], min_downloads: int = 100) -> DataFrame:
    """Union of listings, more than ``min_downloads``, first listing of an id kept.

    Adds the short name and the flag that the card text is not collected yet.
    """
    ranked = [
        df.where(F.col("downloads") > min_downloads).withColumn("_listing", F.lit(i))
        for i, df in enumerate(listings)
    ]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    first = dedupe_first(rows, "id", [F.col("_listing"), F.desc("downloads")])
    return first.drop("_listing").withColumns(
        {"name": last_part("id"), "readme_collected": F.lit(False)})


def mark_collected(cards: DataFrame, collected: DataFrame) -> DataFrame:
    """Set the flag of every id that ``collected`` has."""
    done = collected.select("id").distinct().withColumn("_done", F.lit(True))
    flag = F.col("readme_collected") | F.coalesce(F.col("_done"), F.lit(False))
    return cards.join(done, "id", "left").withColumn("readme_collected", flag).drop("_done")


def dataset_url(dataset: str | Column) -> Column:
    return F.concat(F.lit(DATASET_URL), F.col(dataset) if isinstance(dataset, str) else dataset)


def model_links(used_by: DataFrame) -> DataFrame:
    """Dataset URLs of ``(dataset, models)`` rows with at least one model, each once."""
    cited = used_by.where(F.size("models") > 0)
    return cited.select(dataset_url("dataset").alias("dataset_url")).distinct()


def registry_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Creator, title and table row of dataset URLs; other URLs are dropped."""
    u = F.col(url)
    parts = urls.where(u.rlike(DATASET_URL_PARTS)).select(
        u.alias("url"),
        F.regexp_extract(u, DATASET_URL_PARTS, 1).alias("creator"),
        F.regexp_extract(u, DATASET_URL_PARTS, 2).alias("title"),
    )
    row = F.format_string("| [%s](%s) | %s |", "title", "url", "creator")
    return parts.withColumn("markdown", row)
