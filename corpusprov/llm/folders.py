"""Tables written to the shared folder, read back without their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprov.operators.ordering import shared_folder


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bitmaps of 4 KB in a sieve; together 2 MB, however many ids there are.
SIEVE_PARTS = 512


def fresh(names: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``names`` equals, in capitals or not."""
    taken = {c.lower() for c in names}
    while name.lower() in taken:
        name += "_"
    return name


def sieved(df: DataFrame, key: str, ids: DataFrame, name: str = "_likely") -> DataFrame:
    """Mark rows of ``df`` whose ``key`` may be among the one column of ``ids``.

    A set of hashed bits of a fixed size is broadcast. Rows that aren't marked are certainly
    not among the ids, so they needn't be shuffled to be joined with them. With very many
    ids all rows are marked, and a join does all the work.
    """
    def place(c: Column) -> tuple[Column, Column]:
        h = F.pmod(F.xxhash64(c), F.lit(SIEVE_PARTS * 32768))
        return F.floor(h / 32768).cast("int"), (h % 32768).cast("int")

    part_of, bits_of = fresh(df.columns, "_part"), fresh(df.columns, "_bits")
    part, bit = place(F.col(ids.columns[0]))
    bits = F.broadcast(
        ids.select(part.alias(part_of), bit.cast("long").alias("_bit"))
        .groupBy(part_of).agg(F.bitmap_construct_agg("_bit").alias(bits_of)))
    part, bit = place(F.col(key))
    held = F.conv(F.hex(F.substring(bits_of, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mark = (F.floor(held / F.pow(F.lit(2), bit % 8)) % 2) == 1
    return (
        df.withColumn(part_of, part).join(bits, part_of, "left")
        .withColumn(name, F.coalesce(mark, F.lit(False))).drop(part_of, bits_of))
