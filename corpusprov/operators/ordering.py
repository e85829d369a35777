"""Top-n per group and row numbers that hold up when one group has most of the rows."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder that the session names for checkpoints.

    Only a local session without one gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="corpusprov-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 16 << 20) -> bool:
    """Whether ``df`` can be broadcast: it has few rows, and they are short as JSON.

    This reads ``df``, so use it for configuration-like tables.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.select(size.alias("size")).limit(max_rows + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast only after checking the number and the size of the rows of ``df``.

    A larger table is returned as it is, for a shuffle join with adaptive skew splitting.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def top_n_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; ``order`` should leave no ties.

    For small n Spark keeps n rows per group and task before it shuffles. Above its limit
    for that, groups are first cut down in hashed slices, so no task sees a whole group.
    """
    spark = df.sparkSession
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        slices = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
        first = Window.partitionBy(*by, "_slice").orderBy(*order)
        df = sliced.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
        df = df.drop("_slice", "_rn")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def number_rows(
    df: DataFrame,
    by: list[str],
    order: list[str],
    name: str = "row_number",
    partitions: int | None = None,
) -> DataFrame:
    """Row number of each row in its group, without sorting a group in one task.

    Rows are range-partitioned on group and order and written once, so that every later
    read sees the same ranges. Ranges are numbered on their own and shifted by the rows of
    the group in earlier ranges.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialized(ranged)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        ranged.groupBy(*by, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    keys = [*by, "_range"]
    matches = reduce(
        lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys)
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        ranged.alias("r")
        .join(shift.alias("s"), matches)
        .select("r.*", "s._shift")
        .withColumn(name, F.row_number().over(within) + F.col("_shift"))
        .drop("_range", "_shift")
    )
