"""Repeated and near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

Two lines within ``edits`` edits share one of ``edits + 1`` even segments of the shorter, at
a place that both the edits before it and after it allow. Every distinct line indexes its
segments under its length, and probes the index of each length it may meet with just these
substrings. Keys that one line has alone are dropped before any text is joined. Lines of a
key that more than ``HOT`` entries have are told apart by segments of what is left without
the shared one, which must be within ``edits`` edits as well. Spark's banded ``levenshtein``
with a threshold verifies what is left inside the join, so only links leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.components import components
from corpusprov.llm.folders import fresh, sieved, stored

#: Shorter lines are compared for equality only: a few edits would make them any other.
MIN_CHARS = 20
#: Entries of a segment key beyond which its lines are split by another segment.
HOT = 256
#: How often they are; after three segments two thirds of a line are shared.
SPLITS = 2


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """Index and probe keys of ``line``: ``k``, ``id``, ``indexed`` and the ``rest`` of the line.

    ``seed`` is the key that the lines share already, ``index`` whether an entry of theirs
    may be indexed.
    """
    n = edits + 1
    probes = [
        F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift"))
        for less in range(n) for i in range(n)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    spread = lines.withColumn("size", F.char_length("line")).withColumn("p", F.explode(F.array(*probes)))
    length, i = F.col("size") - F.col("p.less"), F.col("p.i")
    # even segments, of which the last ones have a character more
    short = F.floor(length / n).cast("int")
    longer = F.lit(n) - (length - short * n)
    start = i * short + F.greatest(i - longer, F.lit(0)) + F.col("p.shift")
    width = short + (i >= longer).cast("int")
    part = F.substring(F.col("line"), start + 1, width)
    rest = F.concat(F.substring(F.col("line"), F.lit(1), start), F.substring(F.col("line"), start + width + 1, F.col("size")))
    # a line of the indexed length without a shift is index and probe at once
    indexed = F.col("index") & (F.col("p.less") == 0) & (F.col("p.shift") == 0)
    return spread.select(
        F.xxhash64("seed", i, length, part).alias("k"), "id", indexed.alias("indexed"), rest.alias("rest"))


def _shared(keys: DataFrame) -> DataFrame:
    """The keys ``k`` that an indexed line has in common with another."""
    ends = keys.groupBy("k").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("indexed").alias("any"))
    return ends.where("low != high and any").select("k")


def _split_hot(kept: DataFrame, texts: DataFrame, edits: int, hot: int) -> DataFrame:
    """Entries ``k``, ``id``, ``indexed`` in which those of hot keys have longer keys."""
    done, entries = [], kept
    for level in range(SPLITS):
        busy = entries.groupBy("k").count().where(F.col("count") > hot).select("k")
        busy = stored(busy, "hot-keys")
        if busy.isEmpty():
            break
        done.append(entries.join(busy, "k", "left_anti").select("k", "id", "indexed"))
        if level == 0:  # the rests of lines are worked out where they are needed only
            some = entries.join(busy, "k", "left_semi").select("id").distinct()
            first = texts.join(some, "id").select("id", "line", F.lit(0).cast("long").alias("seed"), F.lit(True).alias("index"))
            entries = _keys(first, edits)
        rests = entries.join(busy, "k", "left_semi").distinct()
        rests = rests.select("id", F.col("rest").alias("line"), F.col("k").alias("seed"), F.col("indexed").alias("index"))
        longer = _keys(rests, edits)
        entries = stored(longer.join(_shared(longer), "k").distinct(), "line-keys", "zstd")
    for part in done:
        entries = entries.select("k", "id", "indexed").unionByName(part)
    return entries.select("k", "id", "indexed")


def line_links(lines: DataFrame, edits: int = 2, hot: int = HOT) -> DataFrame:
    """Links ``a``, ``b`` between distinct lines (``id``, ``line``) within ``edits`` edits."""
    lines = lines.select("id", "line", F.char_length("line").alias("size"))
    packed = (F.col("id") * 2 + F.col("indexed").cast("int")).alias("v")
    whole = lines.withColumn("seed", F.lit(0).cast("long")).withColumn("index", F.lit(True))
    keys = _keys(whole, edits).select("k", packed).repartition("k")  # shuffled once for both uses
    keys = keys.select("k", F.shiftright("v", 1).alias("id"), (F.col("v") % 2 == 1).alias("indexed"))
    kept = stored(keys.join(_shared(keys).hint("shuffle_hash"), "k").distinct(), "line-keys")
    ids = kept.select("id").distinct()
    texts = stored(sieved(lines, "id", ids).where("_likely").drop("_likely").join(ids, "id"), "line-texts", "zstd")
    met = _split_hot(kept, texts, edits, hot).join(texts, "id")
    index = met.where("indexed").select("k", F.col("id").alias("a"), F.col("line").alias("line_a"), F.col("size").alias("size_a"))
    probe = met.select("k", F.col("id").alias("b"), F.col("line").alias("line_b"), F.col("size").alias("size_b"))
    within = F.levenshtein("line_a", "line_b", edits)
    pairs = index.join(
        probe,
        (index.k == probe.k) & (F.col("size_a") <= F.col("size_b")) & (F.col("size_b") - F.col("size_a") <= edits)
        & ((F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))) & (within >= 0))
    return pairs.select("a", "b").distinct()


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def dedup_lines(docs: DataFrame, edits: int = 2, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without the lines that come again: all columns, ``n_lines``, ``n_removed``.

    Lines are cut at line feeds and compared without white space at either end. Lines that
    are chained by links within ``edits`` edits are one class, and so are equal lines below
    ``min_chars`` characters; its first occurrence, by doc_id (null first), row and place,
    stays. Blank lines stay. Null texts stay null and have no lines; an empty text has one,
    which is blank. Of equal rows the first keeps its lines. Columns named as the two added
    are replaced; any other names may occur. Rows are told apart by their place in ``docs``,
    which should be a table that is read again alike.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row, gone, changed = (fresh(names, c) for c in ("row", "gone", "changed"))
    rows = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn(row, F.monotonically_increasing_id())
    spread = rows.select(
        F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc"),
        F.posexplode(F.split("text", "\n")).alias("at", "line"))
    spread = spread.withColumn("line", _trimmed(F.col("line"))).where("line != ''")
    # texts are split once here, and again only where something is removed
    slim = stored(spread.withColumn("digest", F.unhex(F.md5("line"))), "all-lines", "zstd")
    first = F.struct("doc", "row", "at")
    # ids follow first occurrences only loosely; they need to be unique
    distinct = slim.groupBy("digest").agg(F.min(first).alias("first"), F.first("line").alias("line"), F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "lines", "zstd")
    longer = distinct.where(F.char_length("line") >= min_chars).select("id", "line")
    classes = components(line_links(longer, edits), "line-classes")
    known = distinct.select("id", "digest", "first", "n").join(
        classes.withColumnRenamed("node", "id"), "id", "left")
    heads = known.where("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    # only lines that come again anywhere matter from here on
    again = known.where("n > 1 or component is not null").join(heads, "component", "left").select(
        "digest", F.coalesce("head", "first").alias("head"))
    removed = (
        slim.drop("line").join(again, "digest")
        .where(~(F.struct("doc", "row", "at") == F.col("head")))
        .groupBy(F.col("row").alias(row)).agg(F.collect_set("at").alias(gone)))
    removed = stored(removed, "removed")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda _, i: ~F.array_contains(gone, i))
    marked = sieved(rows, row, removed.select(row), changed)
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    whole = marked.where(~F.col(changed)).withColumn(gone, F.lit(None).cast("array<int>"))
    some = marked.where(F.col(changed)).join(removed.hint("merge"), row, "left")
    counted = [
        F.coalesce(feeds + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")]

    def result(part: DataFrame, text: Column) -> DataFrame:
        return part.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], *counted)

    cut = F.when(F.col(gone).isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    return result(some, cut).unionByName(result(whole, F.col("text")))
