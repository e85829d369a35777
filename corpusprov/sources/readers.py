"""Readers for the file formats that corpora come in."""

from __future__ import annotations

import codecs
import io
import lzma
import sys

import pandas as pd
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprov.functions.urls import URL_PATTERN, URL_TERMS

# Functions of this module travel to the executors, which need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INLINE_XZ_BYTES = 64 * 1024 * 1024
LINES_PER_FRAME = 10_000
READ_BYTES = 4 * 1024 * 1024
# Quoted fields may hold line breaks, and quotes are doubled inside them.
CSV_OPTIONS = {"multiLine": True, "escape": '"'}
# Compressions that Spark would take for plain text.
UNREADABLE = (".xz", ".lzma", ".7z", ".rar", ".zip")


def _lines(raw, decoder) -> object:
    """Lines of a binary stream, read piece by piece."""
    rest = ""
    while piece := raw.read(READ_BYTES):
        rest += decoder.decode(piece)
        *whole, rest = rest.split("\n")
        yield from whole
    rest += decoder.decode(b"", final=True)
    if rest:
        yield rest


def _uri(path: str) -> str:
    """Spark writes a local path with one slash, Arrow wants three."""
    local = path.startswith("file:/") and not path.startswith("file:///")
    return "file://" + path.removeprefix("file:") if local else path


def _xz_frames(frames):
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            if content is not None:
                raw = io.BytesIO(content)
            else:
                fs, inner = pyarrow.fs.FileSystem.from_uri(_uri(path))
                raw = fs.open_input_file(inner)
            batch = []
            with lzma.open(raw, "rb") as unpacked:
                for line in _lines(unpacked, codecs.getincrementaldecoder("utf-8")()):
                    if line.strip():
                        batch.append(line)
                    if len(batch) >= LINES_PER_FRAME:
                        yield pd.DataFrame({"value": batch})
                        batch = []
            if batch:
                yield pd.DataFrame({"value": batch})


def read_xz_lines(spark: SparkSession, paths: list[str],
                  inline_bytes: int = INLINE_XZ_BYTES) -> DataFrame:
    """Lines of ``.xz`` text files, one file per task at most, never a whole text in memory.

    Files up to ``inline_bytes`` arrive with Spark's own file access; larger ones are
    opened by path inside the task and streamed.
    """
    files = spark.read.format("binaryFile").load(paths)
    small = files.where(F.col("length") <= inline_bytes).select("path", "content")
    large = files.where(F.col("length") > inline_bytes).select(
        "path", F.lit(None).cast("binary").alias("content"))
    tasks = small.unionByName(large.repartition("path"))
    return tasks.mapInPandas(_xz_frames, "value string")


def read_corpus(spark: SparkSession, paths: list[str] | str, suffix: str | None = None,
                schema: T.StructType | str | None = None) -> DataFrame:
    """Read files by their suffix: Parquet, newline-delimited JSON (also gz, zst, xz) or CSV.

    Give ``schema`` for JSON with only the fields needed; without it the data is read twice.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    suffix = suffix or _suffix_of(paths)
    if suffix.endswith(".parquet"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(*paths)
    if ".json" in suffix:
        if suffix.endswith(".xz"):
            if schema is None:
                raise ValueError("xz files need a schema")
            text = schema if isinstance(schema, str) else schema.simpleString()
            parsed = read_xz_lines(spark, paths).select(F.from_json("value", text).alias("row"))
            return parsed.select("row.*")
        if suffix.endswith(UNREADABLE):
            raise ValueError(f"cannot read {suffix} files")
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.json(paths)
    if suffix.endswith(UNREADABLE):
        raise ValueError(f"cannot read {suffix} files")
    rows = spark.read.csv(paths, header=True, **CSV_OPTIONS)
    if schema is None:
        return rows
    # A schema on the reader would go by position; fields are meant by name.
    fields = spark.createDataFrame([], schema).schema.fields
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in fields])


def _suffix_of(paths: list[str]) -> str:
    found = set()
    for p in paths:
        name = p.rstrip("/").split("/")[-1]
        found.add("." + name.split(".", 1)[1] if "." in name else "")
    kinds = {_kind(s) for s in found}
    if len(kinds) != 1:
        raise ValueError(f"paths of several formats: {sorted(found)}; give a suffix")
    return sorted(found)[0]


def _kind(suffix: str) -> str:
    if suffix.endswith(".parquet"):
        return "parquet"
    if ".json" in suffix:
        return "json.xz" if suffix.endswith(".xz") else "json"
    return "csv"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with its path relative to it, and its size."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.col("length").alias("size"))
    )
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(path).toString().rstrip("/")
    return files.select(F.expr(f"substring(path, {len(base) + 2})").alias("path"), "size")


def sample_rows(df: DataFrame, n: int = 100, order: list[str] | None = None) -> DataFrame:
    """First n rows; give an order when the same rows must come back."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def url_columns(df: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """Per column whose name suggests URLs, whether any value is one.

    With ``n``, only n sampled rows are looked at.

    ``has_urls`` on the row of the whole table is true if any column has them.
    """
    suspects = [
        f.name for f in df.schema.fields
        if any(term in f.name.lower() for term in URL_TERMS)
    ]
    text = [f.name for f in df.schema.fields
            if f.name in suspects and isinstance(f.dataType, T.StringType)]
    spark = df.sparkSession
    flags = {c: F.coalesce(F.max(F.col(f"`{c}`").rlike(URL_PATTERN)), F.lit(False)) for c in text}
    if not suspects:
        return spark.range(1).select(
            F.lit(name).alias("table_name"), F.lit(None).cast("string").alias("column_name"),
            F.lit(False).alias("has_urls"))
    sampled = df.select(*[f"`{c}`" for c in suspects])
    sampled = sampled if n is None else sampled.limit(n)
    one = sampled.agg(*[flags.get(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(suspects)])
    cells = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                      F.col(f"c{i}").alias("has_urls")) for i, c in enumerate(suspects)]
    return one.select(F.inline(F.array(*cells)))


def scan_tables(spark: SparkSession, loaders: dict, n: int | None = None) -> DataFrame:
    """Per dataset whether any of its columns has URLs; one that cannot be read has none.

    ``loaders`` maps names to functions without arguments that give a DataFrame.
    """
    out = None
    for name, load in loaders.items():
        try:
            found = url_columns(load(), name, n).agg(F.max("has_urls").alias("f")).first().f
            error = None
        except Exception as e:
            found, error = False, type(e).__name__
        one = spark.range(1).select(
            F.lit(name).alias("table_name"), F.lit(found).alias("has_urls"),
            F.lit(error).cast("string").alias("error"))
        out = one if out is None else out.unionByName(one)
    return out
