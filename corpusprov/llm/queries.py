"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_token_planes(spark, sf):
    from corpusprov.llm import planes
    from corpusprov.llm.folders import stored

    docs = table(spark, sf, "documents")
    records = stored(planes.encode_records(docs, tokenizer_path("word_bpe_49k.json"), end_id=2), "records")
    return planes.read_documents(records).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_best_fit_packing(spark, sf):
    from corpusprov.llm import packing

    docs = table(spark, sf, "documents")
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def remainder(of: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


@query
def op2_quality_classifier(spark, sf):
    from corpusprov.llm import quality

    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").where("quality is not null").where(remainder(3) != 1)
    ids = labels.select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs.select("doc_id", "text").join(ids, "doc_id"))
    return quality.score(docs, weights, ["doc_id"]).select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_benchmark_decontamination(spark, sf):
    from corpusprov.llm import decontaminate

    hits = decontaminate.benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op9_language_id(spark, sf):
    from corpusprov.llm import language

    docs = table(spark, sf, "documents")
    model = language.learn(docs.where(remainder(4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


ORACLES["op4_benchmark_decontamination"] = """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least(10, len(w)) AS n FROM item_words WHERE len(w) > 0))
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN windows b USING (n, win)
), words_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op1_exact_top_k(spark, sf):
    from corpusprov.llm import topk

    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20, scale=64.0)


ORACLES["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


@query
def op3_line_dedup(spark, sf):
    from corpusprov.llm import lines

    kept = lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), edits=2)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLES["op3_line_dedup"] = """
WITH RECURSIVE occ AS (
  SELECT doc_id, i, parts[i] AS raw, regexp_replace(parts[i], '^\\s+|\\s+$', '', 'g') AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), lines AS (SELECT line, min(CAST(doc_id AS HUGEINT) * 1000000 + i) AS f FROM occ WHERE line <> '' GROUP BY line
), links AS (
  SELECT a.f AS x, b.f AS y FROM lines a JOIN lines b
    ON length(b.line) BETWEEN length(a.line) - 2 AND length(a.line) + 2 AND a.f <> b.f
  -- two edits leave the first, the last or the middle third of a line as it is
  WHERE length(a.line) >= 20 AND length(b.line) >= 20
    AND (a.line[1:length(a.line) // 3] = b.line[1:length(a.line) // 3]
      OR a.line[-(length(a.line) // 3):] = b.line[-(length(a.line) // 3):]
      OR contains(b.line, a.line[length(a.line) // 3 + 1:length(a.line) - length(a.line) // 3 - 1]))
    AND levenshtein(a.line, b.line) <= 2
), reach AS (SELECT f AS x, f AS y FROM lines UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), head AS (SELECT x, min(y) AS h FROM reach GROUP BY x
), kept AS (
  SELECT o.*, l.f IS NOT NULL AND h <> CAST(doc_id AS HUGEINT) * 1000000 + i AS gone
  FROM occ o LEFT JOIN lines l ON o.line = l.line LEFT JOIN head ON head.x = l.f
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM kept GROUP BY doc_id
"""


@query
def op5_balanced_sharding(spark, sf):
    from corpusprov.llm import shards

    placed = shards.shard_documents(table(spark, sf, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_ngram_jaccard_join(spark, sf):
    from corpusprov.llm import jaccard

    return jaccard.jaccard_components(table(spark, sf, "documents"))


ORACLES["op6_ngram_jaccard_join"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT p.x, p.y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY ALL) p JOIN sizes s ON s.doc_id = p.x JOIN sizes t ON t.doc_id = p.y
  WHERE 100 * c >= 75 * (s.n + t.n - c)
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id
"""


@query
def op7_suffix_array_dedup(spark, sf):
    from corpusprov.llm import suffixes

    return suffixes.without_repeats(table(spark, sf, "documents"), length=100).drop("kept")


@query
def op11_merkle_manifest(spark, sf):
    from corpusprov.llm import merkle

    docs = table(spark, sf, "documents")
    text = F.when(remainder(5) == 0, F.translate("text", ascii_uppercase, ascii_lowercase))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select(
        "doc_id", "source", merkle.leaf(*fields, F.col("text")).alias("leaf"),
        F.when(remainder(5) == 0, merkle.leaf(*fields, text)).alias("tampered"))
    proved = merkle.prove(rows, group="source", key="doc_id", carry=["tampered"])
    back = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                        back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The unsigned crc32 of a decimal number, bit by bit; DuckDB has no function for it.
CRC32_SQL = """list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"""

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE rows AS (
  SELECT *, CASE WHEN xor({CRC32_SQL}, 4294967295) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS claimed
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM rows)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n FROM hashed
), low AS (
  SELECT source, 0 AS level, idx, leaf AS h, n FROM leaves UNION ALL
  SELECT source, any_value(level) + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 15) // 16)
  FROM low WHERE n > 1 GROUP BY source, level, idx // 16
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, idx, subroot AS h, n FROM subroots UNION ALL
  SELECT any_value(level) + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 15) // 16)
  FROM high WHERE n > 1 GROUP BY level, idx // 16
), sides AS (
  SELECT source, level, idx, false AS top, coalesce(string_agg(h, '' ORDER BY idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '' ORDER BY idx) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM low WHERE n > 1 WINDOW w AS (PARTITION BY source, level, idx // 16 ORDER BY idx) UNION ALL
  SELECT NULL, level, idx, true, coalesce(string_agg(h, '' ORDER BY idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    coalesce(string_agg(h, '' ORDER BY idx) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
  FROM high WHERE n > 1 WINDOW w AS (PARTITION BY level, idx // 16 ORDER BY idx)
), proofs AS (
  SELECT p.doc_id, p.leaf, p.claimed, p.subroot, s.top, s.level, s.l, s.r
  FROM (SELECT a.*, b.subroot, b.idx AS place FROM leaves a JOIN subroots b ON a.source IS NOT DISTINCT FROM b.source) p
  LEFT JOIN sides s ON (NOT s.top AND s.source IS NOT DISTINCT FROM p.source AND s.idx = p.idx // (16 ** s.level)::BIGINT)
    OR (s.top AND s.idx = p.place // (16 ** s.level)::BIGINT)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT doc_id, leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root,
    sha256(coalesce(string_agg(l || r, '' ORDER BY top, level), '')) AS proof_sha256,
    list_reduce([claimed] || coalesce(list(l || '|' || r ORDER BY top, level) FILTER (l IS NOT NULL), []),
      lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM proofs GROUP BY doc_id, leaf, claimed, subroot)
"""


@query
def op12_byte_bpe(spark, sf):
    import public_tokenizers

    from corpusprov.llm import bpe

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_ranked_lexical_search(spark, sf):
    from corpusprov.llm import lexical

    return lexical.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=20)


ORACLES["op13_ranked_lexical_search"] = """
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), item_terms AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, total GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item_terms JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
