"""Crawl snapshots in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.functions.names import snapshot_monday, snapshot_part


def snapshot_timeline(stats: DataFrame, name: str = "dataset_name") -> DataFrame:
    """Add year, week and the Monday of the week, ordered by year and week."""
    dated = stats.withColumns(
        {"year": snapshot_part(name, "year"), "week": snapshot_part(name, "week")})
    return dated.withColumn("monday", snapshot_monday("year", "week")).orderBy("year", "week", name)


def snapshots_between(stats: DataFrame, first: tuple[int, int], last: tuple[int, int],
                      name: str = "dataset_name") -> DataFrame:
    """Snapshots from one (year, week) to another, both included: a corpus's crawl parents."""
    at = snapshot_part(name, "year") * 100 + snapshot_part(name, "week")
    (y1, w1), (y2, w2) = first, last
    return stats.where(at.between(F.lit(y1 * 100 + w1), F.lit(y2 * 100 + w2)))
