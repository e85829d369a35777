"""Results that must not depend on the cluster's settings or on the number of languages."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from corpusprov.llm import language, tokens, topk


@pytest.mark.parametrize("parts", [1, 2, 200])
def test_top_k_at_any_number_of_shuffle_partitions(spark, parts):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.integers(-8, 9, 6) / 4]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = topk.top_k(df.where("vec_id % 20 = 0"), df, k=20).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    for q in range(0, 120, 20):
        want = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in mine] == want and [r["rank"] for r in mine] == list(range(1, 21))


def test_viterbi_with_many_languages():
    scores = np.full((4, 200), -5.0, np.float32)
    scores[:2, 150] = scores[2:, 199] = 0
    assert language.viterbi(scores, np.array([0, 2, 4]), 1.0).tolist() == [150, 150, 199, 199]


def test_a_driver_gets_one_row_of_counts_for_each_language(spark, monkeypatch):
    rows = [(i, "the house and the garden" if i % 3 else "das haus und der garten", "en" if i % 3 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(12)
    collected, collect = [], type(docs).collect

    def counted(df):
        got = collect(df)
        collected.append(sum(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray))))
        return got

    monkeypatch.setattr(type(docs), "collect", counted)
    model = language.learn(docs)
    assert 0 < sum(collected) <= 2 * 4 * (language.GRAMS + language.WORDS + len(language._NAMES))
    alone = language.learn(docs.coalesce(1))
    for k in ("langs", "gram", "word", "allowed"):
        assert np.array_equal(getattr(model, k), getattr(alone, k))


def test_pieces_that_are_known_are_not_looked_at_again(monkeypatch):
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array(["some words, and 12 more.", "some words", None, "", "caf\u00e9 words.\nEnd " + "x" * 99])
    ids, at = encoder.ids(texts)
    asked, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda pieces: (asked.extend(pieces), learn(pieces)))
    for _ in range(2):
        again, where = encoder.ids(texts)
        assert again.tolist() == ids.tolist() and where.tolist() == at.tolist()
    assert len(asked) <= 2 and all(len(p) > tokens.KEPT_BYTES for p in asked)  # those aren't kept
    # the same where pieces are forgotten in between
    monkeypatch.setattr(tokens, "KEPT_PIECES", 2)
    encoder.clear()
    assert encoder.ids(texts)[0].tolist() == ids.tolist()
