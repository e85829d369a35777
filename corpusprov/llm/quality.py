"""Quality of texts: logistic regression on hashed word n-grams, trained by FTRL.

Features are words and pairs of words, lower-cased, and the same of their shapes (capital,
small, digit, marks as they are, repeats once). A document's score is a sparse dot product
of feature frequencies with the weights.

Training: follow-the-regularised-leader with per-coordinate rates runs in each shard of the
labelled rows; the leaders' weights are averaged and are where the next round starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.arrays import Substrings, lower_ascii, mixed, runs, slices, text_bytes

BITS = 18
#: Weights are averaged in so many parts.
PARTS = 16
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[128:] = 97
_KIND[48:58] = 48


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of each text, and where each text's begin (and the end).

    The first feature of every text is the constant one, in the bucket after the hashed.
    """
    flat, at = text_bytes(column)
    start, end = runs(flat > 32, at)
    first = np.searchsorted(start, at)
    low = Substrings(lower_ascii(flat)).hashes(start, end)
    kind = _KIND[flat]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[start] = True
    kept = np.r_[0, np.cumsum(new)]
    shape = Substrings(kind[new]).hashes(kept[start], kept[end])
    n = len(start)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    out_at = np.r_[0, np.cumsum(4 * size + 1)]
    out = np.full(out_at[-1], 1 << BITS, np.int64)
    shift = np.uint64(64 - BITS)
    place = out_at[text] + 1 + 4 * (np.arange(n) - first[text])
    for k, h in enumerate((low, shape)):
        pair = np.zeros(n, np.uint64)
        pair[1:] = mixed(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5) + np.uint64(k))
        begins = first[:-1][size > 0]
        pair[begins] = mixed(h[begins] + np.uint64(77 + k))
        out[place + 2 * k] = (mixed(h + np.uint64(k)) >> shift).astype(np.int64)
        out[place + 2 * k + 1] = (pair >> shift).astype(np.int64)
    return out, out_at


def margins(weights: np.ndarray, idx: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Constant plus the mean weight of a text's features."""
    n = np.diff(at)
    total = np.add.reduceat(weights[idx], at[:-1]) if len(n) else np.zeros(0)
    constant = weights[1 << BITS]
    return constant + (total - constant) / np.maximum(n - 1, 1)


class Leader:
    """FTRL-proximal with rates by coordinate."""

    def __init__(self, weights: np.ndarray, rate: float, l1: float, l2: float):
        self.rate, self.l1, self.l2 = rate, l1, l2
        self.n = np.zeros(len(weights))
        self.w = weights.astype(np.float64)
        # the state whose leader is the weights given
        self.z = -self.w * (1.0 / rate + l2) - np.sign(self.w) * l1

    def step(self, idx: np.ndarray, at: np.ndarray, label: np.ndarray) -> None:
        p = 1 / (1 + np.exp(-np.clip(margins(self.w, idx, at), -30, 30)))
        n = np.diff(at)
        value = np.repeat(1.0 / np.maximum(n - 1, 1), n)
        value[at[:-1]] = 1.0
        grad = np.bincount(idx, np.repeat(p - label, n) * value, len(self.w))
        k = np.flatnonzero(grad)
        g = grad[k]
        seen = self.n[k] + g * g
        sigma = (np.sqrt(seen) - np.sqrt(self.n[k])) / self.rate
        self.z[k] += g - sigma * self.w[k]
        self.n[k] = seen
        z = self.z[k]
        size = np.maximum(np.abs(z) - self.l1, 0)
        self.w[k] = -np.sign(z) * size / ((1.0 + np.sqrt(seen)) / self.rate + self.l2)


def train(
    labelled: DataFrame, most: int = 24_000, shards: int = 6, rounds: int = 2, epochs: int = 3,
    batch: int = 16, rate: float = 2.0, l1: float = 1e-3, l2: float = 1e-3,
) -> np.ndarray | None:
    """Weights from rows of ``text`` and ``label`` (0 or 1); about ``most`` rows take part.

    The rows are chosen by a hash of the text. Rows with another label or none are left
    out; a null text counts as empty. None without rows.
    """
    rows = labelled.where("label in (0, 1)").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int"))
    n = rows.count()
    if not n:
        return None
    every = -(-n // most)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).withColumn("at", F.xxhash64("text", "label"))
    sample = sample.repartition(shards, "at").sortWithinPartitions("at")
    weights = np.zeros((1 << BITS) + 1, np.float32)

    for _ in range(rounds):
        sent = labelled.sparkSession.sparkContext.broadcast(weights)

        def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                for part in slices(b):
                    idx, at = features(part.column("text"))
                    held.append((idx.astype(np.int32), at, part.column("label").to_numpy().astype(float)))
                    size += part.num_rows
            leader = Leader(sent.value, rate, l1, l2)
            for _ in range(epochs if size else 0):
                for idx, at, label in held:
                    for a in range(0, len(label), batch):
                        b = min(a + batch, len(label))
                        leader.step(idx[at[a] : at[b]], at[a : b + 1] - at[a], label[a:b])
            parts = np.array_split(leader.w, PARTS) if size else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([size] * len(parts), pa.int64()),
                 pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary())],
                names=["part", "n", "weights"])

        def mean(key, table):
            n = table.column("n").to_numpy().astype(float)
            each = [np.frombuffer(w, np.float32) for w in table.column("weights").to_pylist()]
            out = sum(w * (k / n.sum()) for w, k in zip(each, n)).astype(np.float32)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([out.tobytes()], pa.binary())})

        led = sample.mapInArrow(lead, "part int, n bigint, weights binary")
        got = led.groupBy("part").applyInArrow(mean, "part int, weights binary").collect()  # PARTS rows
        weights = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(got, key=lambda r: r["part"])])
    return weights


def score(docs: DataFrame, weights: np.ndarray | None, kept: list[str]) -> DataFrame:
    """``kept`` columns of each row with ``score``, from the whole text, whatever its length.

    Null and empty texts have the score of the constant alone; without weights all score 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(
        np.zeros((1 << BITS) + 1, np.float32) if weights is None else weights)
    types = dict(docs.dtypes)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = 1 / (1 + np.exp(-np.clip(margins(sent.value, *features(part.column("text"))).astype(float), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(p)], names=[*kept, "score"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", score double"
    return docs.select(*kept, *[c for c in ["text"] if c not in kept]).mapInArrow(scored, schema)
