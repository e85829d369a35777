"""File manifests: choosing files, batching them by size, and tracking what is done."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprov.functions.names import basename
from corpusprov.operators.ordering import broadcast_if_small, number_rows

# Default batch size, and the sources that a path list is searched for.
BATCH_BYTES = 100_000_000_000
PATH_MARKS = r"/c4|/cc_|/falcon-refinedweb"
LINES_PER_BATCH = 100


def rule_filter(path: str | Column, prefixes=None, suffix: str = "", excludes=None) -> Column:
    """Path starts with any prefix, ends with the suffix and holds no excluded text.

    A single string stands for a list of one.
    """
    def many(v):
        return [v] if isinstance(v, str) else list(v or [])

    p = F.col(path) if isinstance(path, str) else path
    keep = p.endswith(suffix)
    if many(prefixes):
        keep &= reduce(lambda a, b: a | b, (p.startswith(x) for x in many(prefixes)))
    for text in many(excludes):
        keep &= ~p.contains(text)
    return keep


def files_by_rule(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the number and the bytes of the files that each would read.

    A rule takes a path that starts with any of its ``prefixes`` (any path, if it has none),
    ends with its ``suffix``, which begins with a dot, and holds none of its ``excludes``.
    Rules without files stay, with zeros; files without a size add no bytes.

    A path has few tails that begin at a dot, so rules are found by equal tails, and what
    each task finds is added up before its shuffle.
    """
    numbered = rules.withColumn("_rule", F.xxhash64(F.to_json(F.struct(*rules.columns))))
    wanted = numbered.select("_rule", "prefixes", F.col("suffix").alias("_tail"), "excludes")
    tails = F.expr(
        "transform(sequence(1, length(path) - length(replace(path, '.', ''))), "
        "k -> concat('.', substring_index(path, '.', -k)))")
    spread = manifest.where(F.col("path").contains(".")).select("path", "size", F.explode(tails).alias("_tail"))
    met = spread.join(broadcast_if_small(wanted), "_tail").where(
        ((F.size("prefixes") == 0) | F.exists("prefixes", lambda p: F.col("path").startswith(p)))
        & ~F.exists("excludes", lambda x: F.col("path").contains(x)))
    found = met.groupBy("_rule").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
    return numbered.join(found, "_rule", "left").drop("_rule").withColumns({
        "n_files": F.coalesce("n_files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})


def path_lines(lines: DataFrame, line: str = "value", pattern: str | None = None) -> DataFrame:
    """Trimmed path lines without blanks and ``#`` comments, with their base name."""
    clean = lines.withColumn(line, F.trim(F.col(line)))
    clean = clean.where((F.col(line) != "") & ~F.col(line).startswith("#"))
    if pattern:
        clean = clean.where(F.col(line).rlike(pattern))
    return clean.withColumn("file_name", basename(line))


def chunk_lines(lines: DataFrame, by: list[str], order: list[str],
                size: int = LINES_PER_BATCH) -> DataFrame:
    """Number the lines of each group in order and cut them into batches of ``size``."""
    numbered = number_rows(lines, by, order, "line_number")
    batch = F.floor((F.col("line_number") - 1) / size).cast("int") + 1
    return numbered.withColumn("batch", batch)


def _fill_batches(target: int):
    """Next-fit over sizes in descending order, one step per distinct size.

    Of the m files of a size, the first ``head`` still go to the open batch and the rest
    fill batches of ``per`` files from the next batch on.
    """
    def fill(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size", ascending=False)
        head, first, pers = [], [], []
        batch, used = 1, 0
        for size, m in zip(sizes["size"].tolist(), sizes["m"].tolist()):
            if size > 0:
                room = max(0, (target - used) // size)
            else:
                room = m if used <= target else 0
            fits = min(m, room if used > 0 else max(room, 1))
            per = m if size <= 0 else max(1, target // size)
            head.append(fits)
            first.append(batch)
            pers.append(per)
            left = m - fits
            used += fits * size
            if left:
                opened = -(-left // per)
                batch += opened
                used = (left - (opened - 1) * per) * size
        return sizes.assign(head=head, first=first, per=pers)

    return fill


def size_batches(manifest: DataFrame, by: list[str], target: int = BATCH_BYTES,
                 path: str = "path", size: str = "size") -> DataFrame:
    """Batch number of every file, per group, by decreasing size and then path.

    A batch closes when the next file would take it over ``target`` and it is not empty.
    Only the distinct sizes go through the sequential step: files with B bytes in all have
    at most sqrt(2B) of them. Files of one size are told apart by their number within it.
    Files of unknown size are batch 0 of their group.
    """
    unknown = manifest.where(F.col(size).isNull()).withColumn("batch", F.lit(0))
    manifest = manifest.where(F.col(size).isNotNull())
    by_size = [*by, size]
    sizes = manifest.groupBy(*by_size).agg(F.count(F.lit(1)).alias("m"))
    named = sizes.withColumnRenamed(size, "size")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    filled = named.groupBy(*by).applyInPandas(
        _fill_batches(target), f"{fields}, head bigint, first bigint, per bigint")
    numbered = number_rows(manifest, by_size, [path], "_nth")
    plan = filled.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)],
                         F.col("size").alias("_size"), "head", "first", "per")
    same = reduce(lambda a, b: a & b,
                  [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
                  + [F.col(size) == F.col("_size")])
    beyond = F.col("first") + 1 + F.floor((F.col("_nth") - F.col("head") - 1) / F.col("per"))
    batch = F.when(F.col("_nth") <= F.col("head"), F.col("first")).otherwise(beyond)
    batched = numbered.join(plan, same).select(*manifest.columns, batch.cast("int").alias("batch"))
    return batched.unionByName(unknown)


def batch_stats(batched: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """Files and gigabytes per batch."""
    return batched.groupBy(*by, "batch").agg(
        F.count(F.lit(1)).alias("n_files"), (F.sum(size) / 1e9).alias("gb"))


def batch_totals(batched: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """Total gigabytes, number of batches and mean gigabytes per batch."""
    per_batch = batched.groupBy(*by, "batch").agg(F.sum(size).alias("s"))
    return per_batch.groupBy(*by).agg(
        (F.sum("s") / 1e9).alias("total_gb"), F.count(F.lit(1)).alias("n_batches"),
        (F.sum("s") / 1e9 / F.count(F.lit(1))).alias("mean_gb"))


def size_tally(manifest: DataFrame, size: str = "size") -> DataFrame:
    """Exact median and sum of file sizes."""
    hist = manifest.groupBy(size).agg(F.count(F.lit(1)).alias("m"))
    return hist.agg(F.expr(f"percentile(`{size}`, 0.5D, m)").alias("median_size"),
                    F.sum(F.col(size) * F.col("m")).alias("total_size"))


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done yet, once per key."""
    return todo.select(*keys).distinct().join(done.select(*keys), keys, "left_anti")


def next_batch(batched: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Smallest batch of each group that is not done; groups with none left are absent."""
    return pending(batched, done, [*by, "batch"]).groupBy(*by).agg(F.min("batch").alias("batch"))


def requested_batch(batched: DataFrame, batch: int) -> DataFrame:
    """Files of one batch number; no rows if there is no such batch."""
    return batched.where(F.col("batch") == batch)


def has_batches(batched: DataFrame) -> bool:
    return not batched.isEmpty()


def batch_exists(batched: DataFrame, by: list[str], batch: int) -> DataFrame:
    """``(by..., batch_exists)``: whether each group has a batch of that number."""
    return batched.groupBy(*by).agg(F.max(F.col("batch") == batch).alias("batch_exists"))
