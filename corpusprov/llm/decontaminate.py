"""Find, and remove, passages of benchmark items in documents.

Windows of consecutive benchmark words, hashed, are broadcast; each task slides over the
words of its documents, looks windows up, and compares the words behind every hit. The
broadcast is bounded: a larger benchmark is dealt into parts that each take a pass over the
documents, and the passes are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.arrays import Substrings, lower_ascii, runs, slices, text_bytes

#: Bytes of benchmark text behind one broadcast.
PART_BYTES = 16 << 20

_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False

HITS = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
    "contaminated boolean, items array<string>, spans array<struct<start:bigint,end:bigint>>"
)


class Words:
    """The words of some texts: places, hashes, and each text's first word."""

    def __init__(self, column: pa.Array):
        flat, self.at = text_bytes(column)
        self.flat = lower_ascii(flat)
        self.start, self.end = runs(_WORD[self.flat], self.at)
        self.first = np.searchsorted(self.start, self.at)
        self.text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))
        self.sums = Substrings(Substrings(self.flat).hashes(self.start, self.end))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every n words in a row of one text."""
        last = len(self.start) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        i = np.flatnonzero(self.text[:last] == self.text[n - 1 :])
        return i, self.sums.hashes(i, i + n)

    def words(self, i: int, n: int) -> bytes:
        at = zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist())
        return b" ".join(self.flat[a:b].tobytes() for a, b in at)


def item_windows(items: list[tuple[str, str]], n: int) -> dict[int, dict[bytes, list[str]]]:
    """Windows by their number of words: n, or all words of an item that has fewer."""
    out: dict[int, dict[bytes, set[str]]] = {}
    words = Words(pa.array([t for _, t in items], pa.string()))
    for k, (name, _) in enumerate(items):
        a, b = int(words.first[k]), int(words.first[k + 1])
        size = min(n, b - a)
        for i in range(a, b - size + 1) if size else ():
            out.setdefault(size, {}).setdefault(words.words(i, size), set()).add(name)
    return {s: {w: sorted(v) for w, v in x.items()} for s, x in out.items()}


def _hashed(windows: dict[bytes, list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(pa.array([w.decode() for w in windows], pa.string()))
    h = np.unique(words.sums.hashes(words.first[:-1], words.first[:-1] + size))
    maybe = np.zeros(1 << 20, bool)
    maybe[h & np.uint64((1 << 20) - 1)] = True
    return h, maybe


def _found(docs: DataFrame, known: dict[int, dict[bytes, list[str]]], kept: list[str]) -> DataFrame:
    """One pass over ``docs``; ``kept`` columns are carried along.

    Spans also hold the numbers of their first word and of the word after their last.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    struct = pa.struct([(c, pa.int64()) for c in ("start", "end", "first", "last")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: _hashed(w, n) for n, w in sent.value.items()}
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                change = np.zeros(len(words.start) + 1, np.int64)
                items: dict[int, set[str]] = {}
                for n, (hashes, maybe) in tables.items():
                    i, h = words.windows(n)
                    likely = np.flatnonzero(maybe[h & np.uint64(len(maybe) - 1)])
                    at = np.minimum(np.searchsorted(hashes, h[likely]), len(hashes) - 1)
                    for w in i[likely[hashes[at] == h[likely]]].tolist():
                        names = sent.value[n].get(words.words(w, n))
                        if names:
                            change[w] += 1
                            change[w + n] -= 1
                            items.setdefault(int(words.text[w]), set()).update(names)
                hit = np.cumsum(change[:-1]) > 0
                hits = np.r_[0, np.cumsum(hit)][words.first]
                a, b = runs(hit, words.first)
                owner, spans = words.text[a] if len(a) else a, {}
                places = (owner, words.start[a], words.end[b - 1], a, b)
                for k, x, y, i, j in zip(*(p.tolist() for p in places)):
                    base, word = int(words.at[k]), int(words.first[k])
                    spans.setdefault(k, []).append({"start": x - base, "end": y - base, "first": i - word, "last": j - word})
                names = [sorted(items.get(k, ())) for k in range(part.num_rows)]
                n_hit = np.diff(hits)
                out = [part.column(c) for c in kept] + [
                    pa.array(np.diff(words.first)), pa.array(n_hit), pa.array(list(map(len, names)), pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    pa.array(n_hit > 0), pa.array(names, pa.list_(pa.string())),
                    pa.array([spans.get(k, []) for k in range(part.num_rows)], pa.list_(struct)),
                ]
                yield pa.RecordBatch.from_arrays(out, names=fields)

    tail = HITS.split(", ", 1)[1].replace("end:bigint", "end:bigint,first:bigint,last:bigint")
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", " + tail
    fields = [*kept, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
    return docs.mapInArrow(scan, schema)


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> list[list[tuple[str, str]]]:
    """Items in lists of about ``part_bytes`` of text, each collected on its own.

    Items without an id or without text take no part.
    """
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // part_bytes))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [[(r[0], r[1]) for r in dealt.where(F.col("part") == k).drop("part").collect()] for k in range(n)]


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, part_bytes: int = PART_BYTES, keep_text: bool = False
) -> DataFrame:
    """Per document: words, words inside benchmark windows, the items, and byte spans hit.

    Words are compared after lower-casing A-Z. An item of fewer than ``n`` words is one
    window. Null and empty texts have no words. Rows with equal doc_ids are judged each on
    its own; a null doc_id is kept. Items with equal ids count once. Of other columns none
    is read but the text, if asked for.
    """
    kept = ["doc_id", "text"] if keep_text else ["doc_id"]
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    parts = [item_windows(p, n) for p in benchmark_parts(benchmark, part_bytes)]
    if len(parts) == 1:
        return _found(plain, parts[0], kept).withColumn("spans", _places("spans"))
    # equal rows have equal hits, so a digest of the text stands for it
    marked = plain.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    passes = [_found(marked, p, ["doc_id", "digest"]).withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    whole = passes[0]
    for p in passes[1:]:
        whole = whole.unionByName(p)
    merged = whole.groupBy("doc_id", "digest").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.count_if(F.col("part") == 0).alias("copies"),
    )

    def union_spans(spans: F.Column) -> F.Column:
        # by word numbers, so that spans of neighbouring words are one, as in a single pass
        def add(acc, s):
            last = F.element_at(acc, -1)
            joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
                              last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
            return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= s["first"]),
                          F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
                          ).otherwise(F.concat(acc, F.array(s)))
        return F.aggregate(spans, F.slice(spans, 1, 0), add)

    texts = marked.select("doc_id", "digest", "text")
    joined = merged.withColumn("spans", union_spans(F.col("spans"))).withColumnRenamed("doc_id", "id").join(
        texts.withColumnRenamed("digest", "d"),
        F.col("digest").eqNullSafe(F.col("d")) & F.col("id").eqNullSafe(F.col("doc_id")))
    hit_words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return joined.select(
        *kept, "n_words", hit_words.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "items", _places("spans").alias("spans"))


def _places(spans: str) -> F.Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Documents without any benchmark window, unchanged, with all their columns."""
    known = benchmark_parts(benchmark)
    for part in known:
        docs = _kept(docs, item_windows(part, n))
    return docs


def _kept(docs: DataFrame, known: dict[int, dict[bytes, list[str]]]) -> DataFrame:
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    found = _found(held, known, ["row"])
    return found.where("not contaminated").select("row.*")


def without_spans(hits: DataFrame) -> DataFrame:
    """Texts of ``benchmark_hits(..., keep_text=True)`` without the words that were hit."""
    @F.pandas_udf("string")
    def cut(text, spans):
        def one(t, s):
            if t is None:
                return None
            data, out, at = t.encode(), [], 0
            for x in s:
                out.append(data[at : x["start"]])
                at = x["end"]
            return b"".join([*out, data[at:]]).decode()

        import pandas as pd

        return pd.Series([one(t, s) for t, s in zip(text, spans)], dtype="object")

    return hits.withColumn("text", cut("text", "spans"))
