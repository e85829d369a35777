"""Token ids as binary records: bit or byte planes of fixed-size blocks, each compressed.

A record holds the ids of consecutive whole documents in one byte string::

    block 0: for each plane, 4-byte length and zstandard frame; block 1: ...

Blocks hold ``block`` ids (the last fewer) as unsigned 32-bit numbers. With planes of bytes,
plane k has byte k of every id; with planes of bits, bit k of every id, eight to a byte,
first id in the highest bit. Planes above the highest id of a block are left out. The chunk
index beside it has each block's place, size in ids and number of planes.

A dataset of records is a folder of Parquet files written and read by Spark, so it can lie
in any store. ``file`` and ``record`` number them in ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprov.llm.arrays import slices
from corpusprov.llm.tokens import encoder

#: A record ends after the document that brings it to so many ids.
RECORD_IDS = 1 << 20

RECORDS = pa.schema([
    ("file", pa.int32()), ("record", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary()),
    ("block_at", pa.list_(pa.int64())), ("block_ids", pa.list_(pa.int32())),
    ("block_planes", pa.list_(pa.int32())),
])
RECORDS_DDL = (
    "file int, record int, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, "
    "data binary, block_at array<bigint>, block_ids array<int>, block_planes array<int>"
)


def pack_block(ids: np.ndarray, bits: bool, compress) -> tuple[bytes, int]:
    """One block's planes, and how many there are."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.unpackbits(raw, axis=1, bitorder="little").T[:width]
        planes = np.packbits(rows, axis=1)
    else:
        planes = np.ascontiguousarray(raw.T[: (width + 7) // 8])
    frames = [compress(p.tobytes()) for p in planes]
    return b"".join(struct.pack("<I", len(f)) + f for f in frames), len(frames)


def unpack_block(data: bytes, at: int, n: int, planes: int, bits: bool, decompress) -> np.ndarray:
    rows = []
    for _ in range(planes):
        (size,) = struct.unpack_from("<I", data, at)
        rows.append(np.frombuffer(decompress(data[at + 4 : at + 4 + size]), np.uint8))
        at += 4 + size
    out = np.zeros((n, 4), np.uint8)
    if rows and bits:
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :planes] = np.unpackbits(np.array(rows), axis=1, count=n).T
        out = np.packbits(wide, axis=1, bitorder="little")
    elif rows:
        out[:, :planes] = np.array(rows).T
    return out.reshape(-1).view("<u4")


def encode_records(
    docs: DataFrame, tokenizer: str, end_id: int, bits: bool = False, block: int = 16384, level: int = 3
) -> DataFrame:
    """Records of all documents, sorted by doc_id within and across files.

    Null and empty texts have the end id alone. Rows with a null doc_id come first. Equal
    doc_ids are ordered by their texts, so equal rows can't be told apart. A text of any
    length stays in one record. Other columns are not read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("file", F.spark_partition_id())
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress, encode = zstandard.ZstdCompressor(level=level).compress, encoder(tokenizer)
        file, number, held, names, sizes, total = 0, 0, [], [], [], 0

        def record() -> pa.RecordBatch:
            ids = np.concatenate(held)
            data, at, count, planes = [], [], [], []
            for i in range(0, len(ids), block):
                part = ids[i : i + block]
                packed, n = pack_block(part, bits, compress)
                at.append(sum(map(len, data)) if not at else at[-1] + len(data[-1]))
                data.append(packed)
                count.append(len(part))
                planes.append(n)
            row = [file, number, list(names), list(sizes), len(ids), b"".join(data), at, count, planes]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, RECORDS.types)], schema=RECORDS)

        for batch in batches:
            for piece in slices(batch):
                file = piece.column("file")[0].as_py()
                ids, at = encode.ids(piece.column("text"))
                end = np.array([end_id], "<u4")
                for k, name in enumerate(piece.column("doc_id").to_pylist()):
                    held += [ids[at[k] : at[k + 1]], end]
                    names.append(name)
                    sizes.append(int(at[k + 1] - at[k]) + 1)
                    total += sizes[-1]
                    if total >= RECORD_IDS:
                        yield record()
                        number += 1
                        held, names, sizes, total = [], [], [], 0
        if names:
            yield record()

    return ordered.mapInArrow(records, RECORDS_DDL)


def read_documents(records: DataFrame, bits: bool = False) -> DataFrame:
    """Decode records: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32.

    Each record is decoded alone. ``start`` counts the ids of all documents before.
    """
    before = Window.orderBy("file", "record").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each record of about a million ids
    starts = records.select("file", "record", "n_ids").select(
        "file", "record", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    schema = "file int, record int, doc_id bigint, offset bigint, n_tokens bigint, ids binary, ids_crc32 bigint"
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    fields = [x.split()[0] for x in schema.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                parts = [
                    unpack_block(row["data"], a, n, p, bits, decompress)
                    for a, n, p in zip(row["block_at"], row["block_ids"], row["block_planes"])
                ]
                data = memoryview(np.concatenate(parts).tobytes())
                ends = np.cumsum(row["n_tokens"])
                offsets = ends - row["n_tokens"]
                ids = [bytes(data[4 * a : 4 * b]) for a, b in zip(offsets, ends)]
                n = len(ids)
                columns = [
                    [row["file"]] * n, [row["record"]] * n, row["doc_ids"], offsets, row["n_tokens"],
                    ids, [zlib.crc32(x) for x in ids],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=fields)

    documents = records.drop("n_ids").mapInArrow(decode, schema)
    return documents.join(starts, ["file", "record"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids", "ids_crc32")
