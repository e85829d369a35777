"""Repeatable samples.

Samples order rows by a hash of their key and a seed, so that a rerun, on any number of
executors, takes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprov.operators.ordering import top_n_per_group


def shuffle_key(keys: list[str], seed: int = 42, digest: bool = False) -> Column:
    """Pseudo-random order of rows. ``digest`` uses MD5, which other engines have as well."""
    if digest:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))
    return F.xxhash64(F.lit(seed), *keys)


def take_shuffled(df: DataFrame, n: int, keys: list[str], seed: int = 42,
                  digest: bool = False) -> DataFrame:
    """n rows in seeded random order."""
    return df.orderBy(shuffle_key(keys, seed, digest), *keys).limit(n)


def stratified_sample(df: DataFrame, bucket: str, n: int, keys: list[str], seed: int = 42,
                      digest: bool = False) -> DataFrame:
    """n random rows of each bucket, or all of a smaller one."""
    order = [shuffle_key(keys, seed, digest), *[F.col(k) for k in keys]]
    return top_n_per_group(df, [bucket], order, n)
