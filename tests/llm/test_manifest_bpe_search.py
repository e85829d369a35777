"""Merkle manifest, byte-level BPE and ranked search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusprov.llm import bpe, lexical, merkle

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(leaves, fan):
    """The root, and the siblings of each leaf level by level."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for proof, k in zip(proofs, at):
            run = k // fan * fan
            proof += [x for j, x in enumerate(level[run : run + fan], run) if j != k]
        level, at = [sha(*level[k : k + fan]) for k in range(0, len(level), fan)], [k // fan for k in at]
    return level[0], proofs


def manifest(rows, fan):
    """What ``prove`` must give for (source, key, leaf) rows, sorted."""
    by = {}
    for source, key, leaf in rows:
        by.setdefault(source, []).append((key is not None, key or 0, leaf))
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])], fan) for s in groups}
    root, above = tree([trees[s][0] for s in groups], fan)
    out = []
    for s, top in zip(groups, above):
        for (known, key, leaf), proof in zip(sorted(by[s]), trees[s][1]):
            out.append((s, key if known else None, leaf, trees[s][0], root, sha(*proof, *top)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan", "sizes"), [
    (16, {"a": 300, None: 17, "b": 1, "c": 16, "é": 2}), (2, {"a": 33, "b": 1, "c": 64}), (16, {"a": 1}), (16, {"a": 20}),
    (2, {f"s{i}": 1 + i % 3 for i in range(40)}), (3, {None: 1, "": 1})])
def test_proofs_equal_brute_force(spark, fan, sizes):
    rnd = random.Random(fan)
    rows = [(s, rnd.choice([None, rnd.randrange(10**6)]), sha(str(s), str(rnd.randrange(50)))) for s, n in sizes.items() for _ in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, doc_id bigint, leaf string")
    got = merkle.prove(df, "source", "doc_id", fan=fan).select(
        "source", "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"),
        merkle.folded(F.col("leaf"), F.col("path")).alias("back"))
    got = got.collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == manifest(rows, fan)
    assert all(r.back == r.root for r in got)


def test_copied_ancestors_give_the_same_proofs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "NODES_PER_COPY", 5)
    rows = [("a", i, sha(str(i))) for i in range(150)]
    got = merkle.prove(spark.createDataFrame(rows, "source string, doc_id bigint, leaf string"), "source", "doc_id", fan=2)
    got = got.select("source", "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path"))).collect()
    assert sorted(map(tuple, got), key=repr) == manifest(rows, 2)


def test_a_changed_row_does_not_fold_to_the_root(spark, odd, none):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = odd.withColumn("leaf", merkle.leaf(*fields)).withColumn("other", merkle.leaf(*fields[:-1], F.upper("text")))
    got = merkle.prove(rows, "source", "doc_id", carry=["other", "row"]).collect()
    assert len(got) == 8 and len({r.root for r in got}) == 1 and {r.row for r in got} == {"r"}
    proved = merkle.prove(rows, "source", "doc_id", carry=["other"])
    back = proved.withColumn("back", merkle.folded(F.col("other"), F.col("path"))).collect()
    assert all((r.back == r.root) == (r.other == r.leaf) for r in back) and any(r.back != r.root for r in back)
    one = next(r for r in got if r.doc_id == 5)
    assert one.leaf == sha("1:5", "-", "2:en", "1:1", "6:123 !!")
    assert merkle.prove(rows.limit(0), "source", "doc_id").count() == 0
    with pytest.raises(ValueError):
        merkle.prove(rows.withColumn("root", F.lit(1)), "source", "doc_id", carry=["root"])


@pytest.fixture(scope="module")
def known():
    own = bpe.vocabulary(RANKS, PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


CHARS = ["a", "b", "e", "t", "h", " ", "  ", "\n", "'", "'s", "the", "ing", "é", "ü", "中", "1", "23", "!", "...", "　", "==", " t", "😀", "aaaa"]


def some_text(rnd, n):
    return "".join(rnd.choice(CHARS) for _ in range(n))


def test_prefix_tables_equal_the_library(known):
    own, library = known
    rnd = random.Random(12)
    texts = [some_text(rnd, rnd.randrange(40)) for _ in range(400)] + ["".join(rnd.choice("abeth") for _ in range(2500))]
    for text in texts:
        ids = library.encode_ordinary(text)
        assert np.frombuffer(own.ids(text), "<i4").tolist() == ids == own.back(own.prefixes(text)).tolist()
    long = texts[-1]
    table = own.prefixes(long)
    for k in (1, 7, 500, 2499):  # each prefix of a piece is encoded by the entries so far
        assert own.back(array("i", table[:k])).tolist() == library.encode_ordinary(long[:k])


def test_few_kept_pieces_give_the_same_ids(known, monkeypatch):
    own, library = known
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    text = some_text(random.Random(16), 300)
    assert np.frombuffer(own.ids(text + text), "<i4").tolist() == library.encode_ordinary(text + text)


def test_edits_equal_a_new_table(known):
    own, library = known
    rnd = random.Random(13)
    for k in range(500):
        text = some_text(rnd, rnd.randrange(30)) if k % 5 else "".join(rnd.choice("abeth") for _ in range(700))
        place = np.cumsum([0, *(len(c.encode()) for c in text)])
        i = rnd.randrange(len(place)) if k % 3 else len(place) - 1
        j = min(len(place) - 1, i + rnd.randrange(5))
        new = some_text(rnd, rnd.randrange(5))
        data, table = own.edited(text.encode(), own.prefixes(text), int(place[i]), int(place[j] - place[i]), new.encode())
        assert data.decode() == text[:i] + new + text[j:]
        assert table == own.prefixes(data.decode())
        assert own.back(table).tolist() == library.encode_ordinary(data.decode())


def test_an_edit_does_little_work(known, monkeypatch):
    own, _ = known
    text = " ".join(["abethe" * 400] * 5)
    table, bytes_done = own.prefixes(text), []
    extend = bpe.Vocabulary.extend
    monkeypatch.setattr(bpe.Vocabulary, "extend", lambda self, last, piece, *a, **b: (bytes_done.append(len(piece)), extend(self, last, piece, *a, **b))[1])
    _, new = own.edited(text.encode(), table, 5000, 1, b"x")
    assert len(bytes_done) == 1 and new == own.prefixes(text[:5000] + "x" + text[5001:])
    bytes_done.clear()
    own.edited(text.encode(), table, len(text), 0, b" end")
    assert sum(bytes_done) < 2500  # the last piece at most


def test_documents_round_trip(spark, odd, none, known):
    _, library = known
    encoded = bpe.encode(odd.withColumn("last", F.lit(1)), RANKS, PATTERN, keep=["doc_id", "row", "score", "last"])
    assert encoded.columns == ["doc_id", "row", "score", "last", "ids"]
    got = bpe.decode(encoded, RANKS).collect()
    assert len(got) == 8
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in got) == texts
    assert all(r.ids == library.encode_ordinary(bytes(r.decoded).decode()) for r in got)
    assert bpe.decode(bpe.encode(none, RANKS, PATTERN), RANKS).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [15496])], "doc_id bigint, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(lists, RANKS).orderBy("doc_id").collect()] == [b"", b"", b"Hello"]
    with pytest.raises(Exception, match="doesn't have"):
        bpe.decode(spark.createDataFrame([(3, [99999])], "doc_id bigint, ids array<int>"), RANKS).collect()
    with pytest.raises(ValueError):
        bpe.encode(odd.withColumn("ids", F.lit(1)), RANKS, PATTERN, keep=["ids"])


def test_documents_are_appended_to_and_edited(odd, known):
    _, library = known
    tables = bpe.encode(odd, RANKS, PATTERN, prefixes=True)
    edits = tables.withColumns({
        "at": F.when(F.col("doc_id") == 3, 4).cast("int"), "removed": F.when(F.col("doc_id") == 3, 4).cast("int"),
        "inserted": F.when(F.col("doc_id").isNotNull(), F.lit("Wörter 's"))})
    got = bpe.edit(edits, RANKS, PATTERN).collect()
    assert len(got) == 8
    assert {r.text for r in got if r.doc_id == 3} == {"Ein Wörter 's."} and {r.text for r in got if r.doc_id == 5} == {"123 !!Wörter 's"}
    assert all(r.ids == library.encode_ordinary(r.text) for r in got)


def best(docs, items, k):
    """Every score, by the formulas; documents and items as (id, text)."""
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_ranks_equal_brute_force(spark, monkeypatch, small):
    rnd = random.Random(14)
    if small:
        monkeypatch.setattr(lexical, "BLOCK_ENTRIES", 200)
        monkeypatch.setattr(lexical, "SAMPLE", 40)

    def text(n, w):
        return " ".join(rnd.choice(["x", "Y", "ß", "w"]) + str(int(rnd.random() ** 3 * w)) for _ in range(n))

    docs = [(i, text(rnd.randrange(1, 60), 60)) for i in range(300)]
    docs += [(i, docs[0][1]) for i in range(300, 400)]  # a large group of copies
    docs += [(7, "x1 x1 y2"), (7, "x1 x1 y2"), (None, "x1 x2 x3"), (None, None), (500, ""), (501, "?!"), (502, text(5000, 4000))]
    items = [(i, text(rnd.randrange(1, 12), 60)) for i in range(20)] + [(None, "x1"), (30, None), (31, "--"), (32, "notthere"), (33, "x1 x1 X1"), (33, "x2"), (34, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("clash")).withColumn("score", F.lit(1.5))
    wanted = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(0))
    for part_bytes in (1 << 20, 200):
        got = lexical.rank_documents(frame, wanted, k=20, part_bytes=part_bytes)
        assert sorted(map(tuple, got.collect()), key=repr) == best(docs, items, 20)


def test_search_of_odd_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "word1 Satz"), (2, "123")], "item_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, lexical.rank_documents(odd, items, k=3).collect()), key=repr) == best(rows, [(1, "word1 Satz"), (2, "123")], 3)
    assert lexical.rank_documents(none, items).count() == 0
    assert lexical.rank_documents(odd, items.limit(0)).count() == 0


def test_bounds_hold_for_each_document_of_a_node():
    rnd = np.random.default_rng(15)
    n, width = 200, 80
    lists = [np.sort(rnd.choice(width, rnd.integers(1, 30), replace=False)).astype(np.int32) for _ in range(n)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": list(range(n)), "n": [50] * n, "term": lists, "tf": [rnd.integers(1, 9, len(x)).astype(np.int32) for x in lists]})
    entries = lexical.Entries(batch, rnd.integers(0, 9000, width), n, n * 50)
    ball = lexical.BallTree(entries, rnd.integers(0, 5, width), 5)
    items = lexical.Items([rnd.integers(0, width, 6) for _ in range(10)])
    counts = items.dense(0, 10, ball.terms)
    for node, centre, radius in ball.balls():
        a, b = ball.nodes[node][:2]
        far = np.sqrt(np.stack([np.bincount(ball.group, c * c, 5) for c in counts]))
        bound = (counts @ centre + far @ radius) * (1 + lexical.SLACK) + 1
        for row, most in zip(counts.astype(np.int64), bound):
            assert ball.entries.scores(row, np.arange(a, b)).max() <= most
