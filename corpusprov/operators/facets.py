"""Sections and years of URL paths, compared between datasets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.functions.names import year_month_date
from corpusprov.operators.counts import with_share
from corpusprov.operators.ordering import top_n_per_group


def section_share(facets: DataFrame) -> DataFrame:
    """Rows per section and their share, rows without a section left out.

    The missing section is dropped as a group, after counting: a filter on rows would
    make Spark work out the section twice per row.
    """
    sized = facets.groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), F.count("section").alias("known"))
    return with_share(sized.where(F.col("known") > 0).drop("known"), "n", "share")


def section_share_delta(parent: DataFrame, child: DataFrame, floor: float = 0.01) -> DataFrame:
    """Share in the child minus share in the parent, where either is above ``floor``."""
    p = section_share(parent).select("section", F.col("share").alias("parent_share"))
    c = section_share(child).select("section", F.col("share").alias("child_share"))
    both = p.join(c, "section", "full").na.fill(0.0, ["parent_share", "child_share"])
    kept = both.where((F.col("parent_share") > floor) | (F.col("child_share") > floor))
    return kept.withColumn("delta", F.col("child_share") - F.col("parent_share"))


def section_pct(facets: DataFrame) -> DataFrame:
    """Rows per section over all rows of the dataset, rows without a section included below.

    Both sides of the join use the same counts, so Spark shuffles the rows only once.
    """
    sized = facets.groupBy("dataset_name", "section").agg(
        F.count(F.lit(1)).alias("n"), F.count("section").alias("known"))
    totals = sized.groupBy("dataset_name").agg(
        F.sum("n").alias("total"), F.sum("known").alias("total_known"))
    kept = sized.where(F.col("known") > 0).join(
        totals.where(F.col("total_known") > 0), "dataset_name")
    return kept.select(
        "dataset_name", "section", "n",
        (F.col("n").cast("double") / F.col("total")).alias("percentage"))


def top_sections(pct: DataFrame, n: int = 10) -> DataFrame:
    """Largest sections of each dataset; equal shares go by name."""
    return top_n_per_group(pct, ["dataset_name"], [F.desc("percentage"), F.asc("section")], n)


def _sections_of(pct: DataFrame, dataset: str, name: str) -> DataFrame:
    return pct.where(F.col("dataset_name") == dataset).select(
        "section", F.col("percentage").alias(name))


def common_sections(pct: DataFrame, first: str, second: str) -> DataFrame:
    """Sections that both datasets have."""
    a = _sections_of(pct, first, "p").select("section")
    return a.intersect(_sections_of(pct, second, "p").select("section"))


def common_section_delta(pct: DataFrame, first: str, second: str, n: int = 15) -> DataFrame:
    """Common sections whose percentage differs most, as first minus second."""
    both = _sections_of(pct, first, "first_pct").join(
        _sections_of(pct, second, "second_pct"), "section")
    diff = both.withColumn("pct_diff", F.col("first_pct") - F.col("second_pct"))
    return diff.orderBy(F.desc(F.abs("pct_diff")), "section").limit(n)


def nonnull_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group, the non-null values of every other column."""
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(*(F.count(c).alias(c) for c in others))


def yearmonth_counts(facets: DataFrame) -> DataFrame:
    """Non-null counts per dataset and month."""
    dated = facets.withColumn("yearmonth", year_month_date("year", "month"))
    return nonnull_counts(dated, ["dataset_name", "yearmonth"])


def year_density(facets: DataFrame, after: int = 1960, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density over years per dataset, each scaled by the dataset's share of rows.

    The bandwidth is Scott's, and the grid runs ``cut`` bandwidths past the data. Rows
    first become counts per year, so the sum over the data is one over a few hundred years.
    """
    years = (
        facets.where(F.col("year") > after)
        .groupBy("dataset_name", F.col("year").cast("double").alias("y"))
        .agg(F.count(F.lit(1)).cast("double").alias("m"))
    )
    y, m = F.col("y"), F.col("m")
    every = years.agg(F.sum("m").alias("n_all")).scalar()
    moments = (
        years.groupBy("dataset_name")
        .agg(F.sum(m).alias("n"), (F.sum(m * y) / F.sum(m)).alias("mean"),
             F.min(y).alias("lo"), F.max(y).alias("hi"))
    )
    spread = (
        years.join(moments, "dataset_name")
        .groupBy("dataset_name", "n", "lo", "hi")
        .agg(F.sum(m * F.pow(y - F.col("mean"), 2)).alias("ss"))
        .where((F.col("n") > 1) & (F.col("ss") > 0))
        .withColumn("h", F.sqrt(F.col("ss") / (F.col("n") - 1)) * F.pow(F.col("n"), F.lit(-0.2)))
    )
    low, high = F.col("lo") - cut * F.col("h"), F.col("hi") + cut * F.col("h")
    points = (
        spread.select(
            "dataset_name", "n", "h", low.alias("low"), high.alias("high"),
            F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
        .withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (grid - 1))
    )
    kernel = m * F.exp(-0.5 * F.pow((F.col("x") - y) / F.col("h"), 2))
    norm = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    return (
        years.join(points, "dataset_name")
        .groupBy("dataset_name", "point", "x", "n", "h")
        .agg(F.sum(kernel).alias("k"))
        .select("dataset_name", "point", F.col("x").alias("year"),
                (F.col("k") / norm * F.col("n") / every).alias("density"))
    )
