"""Which texts mention which terms.

Each term has an anchor, one of its pieces of a few characters. A text that holds the term
holds its anchor, so all pieces of a text are looked up in a small table of bits, inside the
scan; the few that pass meet the anchors in a join, and the terms so found are tested on the
whole text. All of it is built-in functions, for any number of terms.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: spellings that count as a mention of the crawl.
CRAWL_SPELLINGS = ["cc-main", "common crawl", "commoncrawl"]
CRAWL_ID = "commoncrawl"
#: Characters of an anchor; a shorter term is its own.
ANCHOR = 8
#: Texts are cut into pieces in chunks of so many characters.
CHUNK = 1 << 16
#: Bits of the sieve at most, 256 KB. With very many terms all pieces pass, and the join does the work.
SIEVE_BITS = 1 << 21
#: Anchors and their terms are broadcast up to this size.
BROADCAST_BYTES = 32 << 20
#: Parts that the texts with one anchor are dealt to where anchors are too many to broadcast.
SALTS = 16
#: Where a character begins, and not its second half.
WHOLE = r"[^\x{dc00}-\x{dfff}]"
#: With more different first characters of anchors, texts are looked at everywhere.
MAX_FIRSTS = 500


def mention_flag(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.lower(t).rlike("|".join(CRAWL_SPELLINGS))


def with_crawl_terms(terms: DataFrame, term_id: str, term: str) -> DataFrame:
    """Terms with text ids, and the spellings of the crawl as terms of one id."""
    rows = [(CRAWL_ID, spelling) for spelling in CRAWL_SPELLINGS]
    crawl = terms.sparkSession.createDataFrame(rows, f"`{term_id}` string, `{term}` string")
    named = terms.select(F.col(term_id).cast("string").alias(term_id), term)
    return named.unionByName(crawl)


def _terms(terms: DataFrame, term_id: str, term: str) -> DataFrame:
    folded = terms.select(F.col(term_id).alias("term_id"), F.lower(F.col(term)).alias("term"))
    return folded.where(F.col("term") != "")


def _empty(id_type: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(id_type))


def _anchors(terms: DataFrame) -> DataFrame:
    """Terms with that one of their pieces which the fewest terms have.

    So terms with a common start do not pile up on one key. Pieces that begin with a space come
    first: only where a text has the first character of an anchor is it looked at.
    """
    more = (F.least(F.length("term"), F.lit(ANCHOR)) - 1).cast("string")
    pattern = F.concat(F.lit(f"(?s)(?=({WHOLE}.{{"), more, F.lit("}))"))
    pieces = F.regexp_extract_all("term", pattern, F.lit(1))
    grams = terms.select("term_id", "term", F.explode(F.array_distinct(pieces)).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return grams.join(shared, "gram").groupBy("term_id", "term").agg(
        F.min(F.struct(~F.startswith("gram", F.lit(" ")), "n", "gram"))["gram"].alias("gram"))


def _sieve(anchors: DataFrame) -> tuple[Callable[[Column], Column], list[int], str, bool]:
    """A test that holds for all anchors and for few other pieces, the anchors' lengths, a
    pattern of their first characters, and whether they can be broadcast."""
    place = F.xxhash64("gram").bitwiseAND(SIEVE_BITS - 1)
    held = (
        anchors.select(place.alias("at"), F.length("gram").alias("size"), F.left("gram", F.lit(1)).alias("first"),
                       (F.octet_length("term") + 64).alias("bytes"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"),
             F.collect_set("size").alias("sizes"), F.collect_set("first").alias("firsts"),
             F.sum("bytes").alias("bytes"))
        .collect())  # SIEVE_BITS / 64 rows at most
    words = [0] * (SIEVE_BITS // 64)
    for row in held:
        words[row.word] = row.bits & (2**64 - 1)
    marked = sum(w.bit_count() for w in words)
    while len(words) > 64 and len(words) >= marked:  # keep 64 bits for each that is set
        half = len(words) // 2
        words = [a | b for a, b in zip(words[:half], words[half:])]
    signed = json.dumps([w - 2**64 if w >> 63 else w for w in words])
    table = F.from_json(F.lit(signed), "array<bigint>")

    def passes(gram: Column) -> Column:
        at = F.xxhash64(gram).bitwiseAND(len(words) * 64 - 1)
        return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    firsts = sorted({c for row in held for c in row.firsts})
    first = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in firsts) + "]" if 0 < len(firsts) <= MAX_FIRSTS else WHOLE
    small = sum(row.bytes for row in held) <= BROADCAST_BYTES
    return passes, sorted({n for row in held for n in row.sizes}), first, small


def _candidates(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """``digest`` and the terms whose anchor is in the text with that digest, as ``found``."""
    passes, sizes, first, small = _sieve(anchors)
    # a look-ahead finds overlapping pieces in one pass; chunks overlap by a piece
    chunk = F.regexp_extract_all("body", F.lit(f"(?s)(?=(.{{1,{CHUNK + ANCHOR - 1}}})).{{1,{CHUNK}}}"), F.lit(1))
    piece = F.regexp_extract_all("chunk", F.lit(f"(?s)(?=({first}.{{0,{max(sizes, default=1) - 1}}}))"), F.lit(1))
    grams = texts.select("digest", F.explode(chunk).alias("chunk")).select("digest", F.explode(piece).alias("gram"))
    if len(sizes) > 1:
        grams = grams.select("digest", F.explode(F.array(*[F.left("gram", F.lit(k)) for k in sizes])).alias("gram"))
    grams = grams.where(passes(F.col("gram"))).distinct()
    if small:
        met = grams.join(F.broadcast(anchors), "gram")
    else:
        salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
        copies = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = grams.withColumn("salt", salt).join(copies, ["gram", "salt"])
    return met.groupBy("digest").agg(F.collect_set(F.struct("term_id", "term")).alias("found"))


def mention_lists(docs: DataFrame, terms: DataFrame, doc_id: str, text: str, term_id: str,
                  term: str) -> DataFrame:
    """Each row's id with the sorted list of terms that its text contains, ignoring case.

    Rows are told apart by their text alone, so repeated and NULL ids have each their own list;
    equal texts are matched once. A NULL text mentions nothing, and an empty or NULL term is
    mentioned nowhere. The number of terms only decides whether the anchors are broadcast.
    """
    folded = _terms(terms, term_id, term)
    anchors = _anchors(folded)
    rows = docs.select(doc_id, F.lower(F.col(text)).alias("body")).withColumn("digest", F.md5("body"))
    found = _candidates(rows.select("digest", "body"), anchors)
    held = F.filter("found", lambda t: F.contains(F.col("body"), t["term"]))
    ids = F.array_sort(F.array_distinct(F.transform(held, lambda t: t["term_id"])))
    return rows.join(found, "digest", "left").select(
        doc_id, F.coalesce(ids, _empty(terms.schema[term_id].dataType)).alias("mentioned"))


def find_mentions(docs: DataFrame, terms: DataFrame, doc_id: str, text: str, term_id: str,
                  term: str) -> DataFrame:
    """(doc_id, term_id) rows instead of lists."""
    lists = mention_lists(docs, terms, doc_id, text, term_id, term)
    return lists.select(doc_id, F.explode("mentioned").alias("term_id"))


def mentions_depth1(mentions: DataFrame, wanted: DataFrame, excluded: list[DataFrame],
                    doc_id: str = "id") -> DataFrame:
    """Ids that mention any wanted id and are in none of the excluded tables.

    ``mentions`` is ``(doc_id, term_id)``.
    """
    hit = mentions.join(wanted.select(F.col("id").alias("term_id")), "term_id", "left_semi")
    out = hit.select(doc_id).distinct()
    for table in [wanted, *excluded]:
        out = out.join(table.select(F.col("id").alias(doc_id)), doc_id, "left_anti")
    return out
