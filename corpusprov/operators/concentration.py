"""How unevenly URLs spread over domains.

All of it works on the histogram of counts (how many domains have x URLs). Positive counts
with sum T take at most sqrt(2T) different values, about a million for a trillion URLs, so
ordering the histogram is cheap where ordering the domains is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bucket edges and labels.
SIZE_EDGES = [1, 2, 10, 100, 1000, 10000, 100000]
SIZE_LABELS = ["1", "2-9", "10-99", "100-999", "1K-9.9K", "10K-99K", "100K+"]
CUT_EDGES = [0, 1, 10, 100, 1000]
CUT_LABELS = ["one", "small", "medium", "large", "very_large"]
LOG_EDGES = 50


def count_histogram(counts: DataFrame, by: list[str] | None = None,
                    value: str = "url_count") -> DataFrame:
    """``(by..., x, m)``: m domains have x URLs."""
    known = counts.where(F.col(value).isNotNull())
    return known.groupBy(*(by or []), F.col(value).cast("bigint").alias("x")).agg(
        F.count(F.lit(1)).alias("m"))


def _ranked(hist: DataFrame, by: list[str]) -> DataFrame:
    """Add domains and URLs before each count value, and the totals."""
    ordered = Window.partitionBy(*by).orderBy("x")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    urls = F.col("x") * F.col("m")
    return hist.select(
        *by, "x", "m",
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum(urls).over(before), F.lit(0)).alias("urls_before"),
        F.sum("m").over(every).alias("n"),
        F.sum(urls).over(every).alias("t"),
    )


def gini(counts: DataFrame, by: list[str] | None = None, value: str = "url_count") -> DataFrame:
    by = by or []
    ranked = _ranked(count_histogram(counts, by, value), by)
    x, m, r = (F.col(c).cast("double") for c in ("x", "m", "n_before"))
    n, t = F.max("n").cast("double"), F.max("t").cast("double")
    weighted = F.sum(x * (m * r + m * (m + 1) / 2))
    return ranked.groupBy(*by).agg((2 * weighted / (n * t) - (n + 1) / n).alias("gini"))


def lorenz_curve(counts: DataFrame, by: list[str] | None = None, value: str = "url_count",
                 origin: bool = False) -> DataFrame:
    """Corner points of the Lorenz curve, in percent.

    The curve is a straight line over domains of equal count, so its corners are all of it.
    """
    by = by or []
    ranked = _ranked(count_histogram(counts, by, value), by)
    curve = ranked.select(
        *by, F.col("x").alias("url_count"),
        (100.0 * (F.col("n_before") + F.col("m")) / F.col("n")).alias("pct_domains"),
        (100.0 * (F.col("urls_before") + F.col("x") * F.col("m")) / F.col("t")).alias("pct_urls"),
    )
    if origin:
        zero = curve.select(*by).distinct() if by else curve.limit(1).select()
        curve = curve.unionByName(zero.select(
            *by, F.lit(0).cast("bigint").alias("url_count"),
            F.lit(0.0).alias("pct_domains"), F.lit(0.0).alias("pct_urls")))
    return curve


def _urls_up_to(rank: Column) -> Column:
    """URLs of the ``rank`` smallest domains."""
    inside = (F.col("n_before") < rank) & (rank <= F.col("n_before") + F.col("m"))
    return F.max(F.when(inside, F.col("urls_before") + (rank - F.col("n_before")) * F.col("x")))


def top_share_pct(counts: DataFrame, by: list[str] | None = None,
                  value: str = "url_count") -> DataFrame:
    """Percent of URLs beyond the 99th and 90th percentile of domains, and the upper median."""
    by = by or []
    ranked = _ranked(count_histogram(counts, by, value), by)
    n = F.col("n")

    def rank(f: float) -> Column:
        return F.floor(F.lit(f) * n).cast("bigint") + 1

    mid = F.floor(n / 2).cast("bigint") + 1
    inside = (F.col("n_before") < mid) & (mid <= F.col("n_before") + F.col("m"))
    t = F.max("t").cast("double")
    return ranked.groupBy(*by).agg(
        (100 - 100.0 * _urls_up_to(rank(0.99)) / t).alias("top_1_pct"),
        (100 - 100.0 * _urls_up_to(rank(0.90)) / t).alias("top_10_pct"),
        F.max(F.when(inside, F.col("x"))).alias("median_urls"),
    )


def _unfold(one: DataFrame, by: list[str], names: list[str], label: str, value: str) -> DataFrame:
    cells = [F.struct(F.lit(n).alias(label), F.col(f"_{i}").alias(value))
             for i, n in enumerate(names)]
    return one.select(*by, F.inline(F.array(*cells)))


def size_bucket_pct(counts: DataFrame, by: list[str] | None = None,
                    value: str = "url_count") -> DataFrame:
    """Percent of domains in each size bucket; the last one is open."""
    by = by or []
    x = F.col(value)
    sums = []
    for i, low in enumerate(SIZE_EDGES):
        inside = x >= low
        if i + 1 < len(SIZE_EDGES):
            inside &= x < SIZE_EDGES[i + 1]
        sums.append((100.0 * F.count(F.when(inside, 1)) / F.count(F.lit(1))).alias(f"_{i}"))
    return _unfold(counts.groupBy(*by).agg(*sums), by, SIZE_LABELS, "bucket", "pct_domains")


def cut_bucket(value: str | Column = "url_count") -> Column:
    """Right-closed bucket of a count; NULL for zero or less."""
    x = F.col(value) if isinstance(value, str) else value
    out = F.when(x <= CUT_EDGES[0], F.lit(None).cast("string"))
    for high, label in zip(CUT_EDGES[1:], CUT_LABELS):
        out = out.when(x <= high, label)
    return out.when(x > CUT_EDGES[-1], CUT_LABELS[-1])


def cut_bucket_counts(counts: DataFrame, value: str = "url_count") -> DataFrame:
    """Domains per right-closed bucket, empty buckets included."""
    bucket = cut_bucket(value)
    sums = [F.count(F.when(bucket == label, 1)).alias(f"_{i}")
            for i, label in enumerate(CUT_LABELS)]
    return _unfold(counts.agg(*sums), [], CUT_LABELS, "bucket", "n_domains")


def log_histogram(counts: DataFrame, value: str = "url_count") -> DataFrame:
    """Domains per log-spaced bin between 1 and the largest count; the last bin is closed.

    The bin follows from a logarithm and is then set right against the edges themselves.
    """
    bins = LOG_EDGES - 1
    hist = count_histogram(counts, value=value).where(F.col("x") >= 1)
    top = hist.agg(F.max("x").cast("double")).scalar()

    def edge(k: Column) -> Column:
        return F.pow(F.lit(10.0), F.col("log_top") * k / bins)

    x = F.col("x").cast("double")
    guess = F.when(
        F.col("log_top") > 0,
        F.least(F.floor(bins * F.log10(x) / F.col("log_top")), F.lit(bins - 1)),
    ).otherwise(bins - 1).cast("bigint")
    binned = (
        hist.withColumn("log_top", F.log10(top))
        .withColumn("g", guess)
        .withColumn(
            "bin",
            F.when((F.col("g") > 0) & (x < edge(F.col("g"))), F.col("g") - 1)
            .when((F.col("g") < bins - 1) & (x >= edge(F.col("g") + 1)), F.col("g") + 1)
            .otherwise(F.col("g")),
        )
        .groupBy("bin")
        .agg(F.sum("m").alias("n_domains"))
    )
    every = counts.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return (
        every.join(binned, "bin", "left")
        .withColumn("log_top", F.log10(top))
        .select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"),
                F.coalesce("n_domains", F.lit(0)).cast("bigint").alias("n_domains"))
    )


def count_summary(counts: DataFrame, by: list[str] | None = None,
                  value: str = "url_count") -> DataFrame:
    """Domains, and mean, median and largest count."""
    by = by or []
    hist = count_histogram(counts, by, value)
    return hist.groupBy(*by).agg(
        F.sum("m").alias("n_domains"),
        (F.sum(F.col("x") * F.col("m")).cast("double") / F.sum("m")).alias("mean_urls"),
        F.expr("percentile(x, 0.5D, m)").alias("median_urls"),
        F.max("x").alias("max_urls"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns of a table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
