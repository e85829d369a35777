"""Every stage on planted cases: what it must drop, and what must stay."""

import random

import corpus_pipeline

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


def test_stages_drop_planted_cases_and_keep_clean_documents(spark, tmp_path):
    line = "a line of some length that two documents have in common"
    passage = prose(100, 14)
    near = prose(5)
    texts = {
        1: prose(1), 2: f"{line}\n{prose(2)}", 3: f"{prose(3)}\n{line}", 4: "12 34 !!", 5: near,
        6: near.replace(near.split()[30], "changed"), 7: f"{prose(7, 20)} {passage.upper()} {prose(8, 20)}",
        8: line, 9: None, 10: "", 11: prose(11, 2000)}
    rows = [(i, "s", "en", len(t or ""), t) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        left[name] = {r.doc_id: r for r in docs.collect()}
    assert set(left["language_id"]) == {1, 2, 3, 5, 6, 7, 8, 11}
    assert set(left["line_dedup"]) == {1, 2, 3, 5, 6, 7, 11}  # nothing is left of 8
    assert left["line_dedup"][2].text == texts[2] and left["line_dedup"][3].text == prose(3)
    assert left["line_dedup"][3].n_chars == len(prose(3))
    assert set(left["ngram_jaccard_join"]) == {1, 2, 3, 5, 7, 11}
    assert set(left["benchmark_decontamination"]) == {1, 2, 3, 5, 11}

    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in placed} == {1, 2, 3, 5, 11}
    for i in (1, 2, 3, 5, 11):  # pieces of a document follow each other without a gap
        own = sorted((r for r in placed if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    for s in {r.sequence_id for r in placed}:
        own = sorted((r for r in placed if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 2048
