"""KL divergence of domain distributions, for one pair or for all pairs in one job.

With a and b the counts of a domain in P and Q, A and B their totals, and epsilon standing
in for a missing q, the sum of p*ln(p/q) over P's domains expands to

    sum(a ln a)/A - ln A - sum_matched(a ln b)/A + (a_matched/A) ln B - (a_unmatched/A) ln eps

Every term is a plain sum over domains. So one shuffle on the domain brings a and b together
for all pairs, and the totals fall out of the same pass: no join of P with Q, no window, and
no second read for totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprov.functions.names import pair_key
from corpusprov.operators.ordering import broadcast_if_small, materialized
from corpusprov.sources.sinks import append_results, read_results

# Fixed value: stands in for the probability of a domain that Q does not have.
EPSILON = 1e-12
RESULT_SCHEMA = "pair_id string, pair_key string, kl_divergence double, computed_at timestamp"


def pairs_frame(spark: SparkSession, pairs: list[tuple[list[str], list[str]]]) -> DataFrame:
    """Pairs of (P's datasets, Q's datasets) as a table."""
    rows = [([p] if isinstance(p, str) else list(p), [q] if isinstance(q, str) else list(q))
            for p, q in pairs]
    return spark.createDataFrame(rows, "sources array<string>, targets array<string>")


def pair_id(sources: str, targets: str) -> Column:
    """What a pair is: a digest of the full names of either side, in any order, once each.

    ``pair_key`` is only a label, which different pairs may share.
    """
    sides = F.struct(F.array_sort(F.array_distinct(sources)), F.array_sort(F.array_distinct(targets)))
    return F.sha2(F.to_json(sides), 256)


def pair_members(pairs: DataFrame) -> DataFrame:
    """(pair, side, dataset_name), once per dataset of a side; ``pair`` is the pair's number."""
    def short(names: str) -> Column:
        return F.array_distinct(F.transform(names, lambda n: F.element_at(F.split(n, "/"), -1)))

    p, q = (
        pairs.select("pair", F.lit(side).alias("side"), F.explode(short(col)).alias("dataset_name"))
        for side, col in (("p", "sources"), ("q", "targets")))
    return p.unionByName(q)


def require_known(members: DataFrame, known: DataFrame) -> None:
    """Raise when a pair names a dataset that is not there, instead of taking it as empty.

    Of ``known`` only ``dataset_name`` is read, which for a partitioned table is its folders.
    """
    missing = (
        members.select("dataset_name")
        .distinct()
        .join(known.select("dataset_name").distinct(), "dataset_name", "left_anti")
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("dataset_name")).alias("names"))
        .first()
    )
    if missing.n:
        raise ValueError(f"{missing.n} unknown datasets: {missing.names}")


def kl_by_pair(rows: DataFrame, merge: bool = True) -> DataFrame:
    """KL per pair from rows ``(pair, side, domain, url_count)``.

    ``merge`` adds up the rows of a domain on each side first. Without it every row keeps
    its own probability and each row of P meets each row of Q with its domain; that sum
    too has a closed form per domain, so no pair of rows is ever built.

    Counts of zero or less add nothing. A NULL domain matches nothing. Without rows on
    P's side the result is NULL.
    """
    n = F.col("url_count").cast("double")
    p, q = F.col("side") == "p", F.col("side") == "q"
    per_domain = rows.where(F.col("url_count") > 0).groupBy("pair", "domain").agg(
        F.sum(F.when(p, n)).alias("a"),
        F.sum(F.when(q, n)).alias("b"),
        F.sum(F.when(p, n * F.ln(n))).alias("rows_a_ln_a"),
        F.sum(F.when(q, F.ln(n))).alias("rows_ln_b"),
        F.count(F.when(q, 1)).cast("double").alias("rows_b"),
    )
    a, b = F.col("a"), F.col("b")
    matched = b.isNotNull() & F.col("domain").isNotNull()
    # Times that a row of P is used: once per row of Q that it meets.
    uses = F.when(matched, F.lit(1.0) if merge else F.col("rows_b")).otherwise(1.0)
    a_ln_a = a * F.ln(a) if merge else F.col("rows_a_ln_a")
    ln_b = F.ln(b) if merge else F.col("rows_ln_b")
    sums = per_domain.groupBy("pair").agg(
        F.sum(a).alias("total_a"),
        F.sum(b).alias("total_b"),
        F.sum(a * uses).alias("a_used"),
        F.sum(a_ln_a * uses).alias("s_ln_a"),
        F.sum(F.when(matched, a * ln_b)).alias("s_ln_b"),
        F.sum(F.when(matched, a * uses)).alias("a_matched"),
        F.sum(F.when(~matched, a)).alias("a_unmatched"),
    )
    c = F.col
    zero = F.lit(0.0)
    total = (
        c("s_ln_a")
        - c("a_used") * F.ln("total_a")
        - F.coalesce(c("s_ln_b"), zero)
        + F.coalesce(c("a_matched") * F.ln("total_b"), zero)
        - F.coalesce(c("a_unmatched"), zero) * F.ln(F.lit(EPSILON))
    )
    return sums.select("pair", (total / c("total_a")).alias("kl_divergence"))


def kl_divergence(p: DataFrame, q: DataFrame, key: str = "domain", merge: bool = True) -> DataFrame:
    """KL(P || Q) of two count tables, as one row."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(0).alias("pair"), F.lit(name).alias("side"),
                         F.col(key).alias("domain"), "url_count")

    kl = kl_by_pair(side(p, "p").unionByName(side(q, "q")), merge)
    # An aggregate over no group still gives a row, so an empty P gives NULL, not nothing.
    return kl.agg(F.max("kl_divergence").alias("kl_divergence"))


def kl_all_pairs(counts: DataFrame, pairs: DataFrame, merge: bool = True,
                 check_names: bool = True, known: DataFrame | None = None) -> DataFrame:
    """KL of every pair in one job: pair_id, pair_key and kl_divergence, a row for each pair.

    ``counts`` is ``(dataset_name, domain, url_count)``. It is shuffled once, on the domain, as it
    is; what different datasets have of a domain meets the table of pairs there, and is
    summed per pair before sums are shuffled. So a row is not repeated for the pairs that use
    it until it is where they need it. Unknown names are errors unless ``check_names`` is off,
    which takes them as empty. They are looked for in ``known``, which may be the folders of
    the table or what the counts are made of; without it the counts are worked out twice.
    The pairs are worked out once and read from the checkpoint folder.
    """
    pairs = materialized(pairs.select(
        "sources", "targets", pair_id("sources", "targets").alias("pair_id"),
        pair_key("sources", "targets").alias("pair_key"), F.monotonically_increasing_id().alias("pair")))
    members = pair_members(pairs)
    if check_names:
        require_known(members, counts if known is None else known)
    by_domain = counts.select("dataset_name", "domain", "url_count").repartition("domain")
    rows = by_domain.join(broadcast_if_small(members), "dataset_name").select("pair", "side", "domain", "url_count")
    found = kl_by_pair(rows, merge)
    return pairs.join(found, "pair", "left").select("pair_id", "pair_key", "kl_divergence")


def datasets_of(pairs: list[tuple[list[str], list[str]]]) -> list[str]:
    """All dataset names of some pairs, to filter a partitioned table with before its scan."""
    names = {n.split("/")[-1] for p, q in pairs
             for side in (p, q) for n in ([side] if isinstance(side, str) else side)}
    return sorted(names)


def update_results(counts: DataFrame, pairs: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Compute the pairs that the result table at ``path`` does not have yet, and add them.

    Read the table with ``sources.current_results``: two runs at once can both add a pair.
    """
    stored = read_results(counts.sparkSession, path, RESULT_SCHEMA).select("pair_id")
    keyed = pairs.withColumn("pair_id", pair_id("sources", "targets")).dropDuplicates(["pair_id"])
    todo = keyed.join(stored, "pair_id", "left_anti").drop("pair_id")
    append_results(kl_all_pairs(counts, todo, known=known), path, "pair_id", RESULT_SCHEMA)
