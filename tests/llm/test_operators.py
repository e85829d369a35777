"""Each operator on small tables: against brute force, and on odd rows."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusprov.llm import decontaminate, jaccard, language, lines, packing, planes, quality, shards, suffixes, topk
from corpusprov.llm.folders import stored
from corpusprov.llm.tokens import Encoder

DOCS = "doc_id bigint, text string"


def words(rnd, n, vocabulary=40):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.integers(-2, 3, 8) / 4]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None] + [0.0] * 6), (62, [float("nan")] * 8), (63, [1e300] * 8), (64, [1e300] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(df.where("vec_id % 20 = 0 or vec_id = 63"), df, k=5).collect()
    sound = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if v and None not in v and np.isfinite(v).all()}
    for q in (0, 20, 40, 63):
        want = sorted((-max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(sound[q], v)))), i) for i, v in sound.items() if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert not topk.top_k(df.limit(0), df.limit(0)).count()


def test_quality_learns_marks(spark, odd, none):
    rnd = random.Random(2)
    rows = [(i, words(rnd, 30) if i % 2 else words(rnd, 30).upper().replace(" ", "!! "), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    weights = quality.train(df.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in quality.score(df, weights, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(300, 400))
    assert all(0 <= r.score <= 1 for r in quality.score(odd.drop("score"), weights, ["doc_id"]).collect())
    assert quality.train(df.limit(0)) is None
    assert quality.score(none.drop("score"), None, ["doc_id"]).count() == 0


def test_line_classes_keep_their_first_line(spark, odd):
    base = "a line that is long enough to take part"
    rows = [(1, f"{base}\nshort"), (2, f"{base}x\n{base.replace('long', 'lang')}\nanother line of quite other words"), (3, base[:-3])]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "another line of quite other words" and got[2].n_lines == 3
    assert got[3].text == base[:-3]  # three edits away
    out = lines.dedup_lines(odd).collect()
    assert len(out) == 8 and sum(r.n_removed for r in out) == 2  # the second long text and short line
    assert next(r for r in out if r.doc_id is None).n_lines == 0
    assert lines.dedup_lines(odd.limit(0)).count() == 0


def test_short_lines_go_where_they_are_equal_and_blank_ones_stay(spark):
    rows = [(2, "yes\n\n \nno"), (1, "\tyes \n\nyes!\r"), (3, "yes"), (None, "no")]
    names = ["_part", "_bits", "gone", "row", "ROW_", "_row", "_lines", "changed", "n_removed"]
    df = spark.createDataFrame([(*r, *range(9)) for r in rows], f"{DOCS}, {', '.join(f'{c} int' for c in names)}")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert {i: (r.text, r.n_lines, r.n_removed) for i, r in got.items()} == {
        None: ("no", 1, 0), 1: ("\tyes \n\nyes!\r", 3, 0), 2: ("\n ", 4, 2), 3: ("", 1, 1)}
    assert all([r[c] for c in names[:-1]] == list(range(8)) for r in got.values())


@pytest.mark.parametrize("edits, hot", [(1, 256), (2, 256), (1, 3), (2, 3)])
def test_line_links_equal_brute_force(spark, edits, hot):
    rnd = random.Random(edits)
    texts = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 9))) for _ in range(60)}
    if hot < 256:  # lines that share a long beginning, end or middle
        one = ["2024-01-01 node ", "", " is down since noon"]
        texts = {one[k % 3] + one[2] * (k % 2) + f"{rnd.randrange(40):b}" + one[2 - k % 3] for k in range(90)}
    rows = list(enumerate(sorted(texts)))
    df = spark.createDataFrame(rows, "id bigint, line string")
    got = {tuple(sorted(r)) for r in lines.line_links(df, edits, hot).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == {(i, j) for i, a in rows for j, b in rows if i < j and distance(a, b) <= edits}


def test_windows_in_one_pass_or_several(spark, odd):
    rnd = random.Random(3)
    passage = words(rnd, 14, 1000)
    docs = spark.createDataFrame([(1, f"x {passage.upper()} y"), (2, words(rnd, 30, 1000)), (3, "so few words"), (4, None)], DOCS)
    items = spark.createDataFrame([(1, passage), (2, "few, WORDS"), (3, None), (None, "x")], "item_id bigint, text string")
    want = {1: (16, 14, ["1"]), 2: (30, 0, []), 3: (3, 2, ["2"]), 4: (0, 0, [])}
    for part_bytes in (1 << 20, 20):
        got = decontaminate.benchmark_hits(docs, items, part_bytes=part_bytes, keep_text=True)
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == want
        kept = {r.doc_id: r.text for r in decontaminate.without_spans(got).collect()}
        assert kept[1].split() == ["x", "y"] and kept[3].split() == ["so"]
    assert {r.doc_id for r in decontaminate.clean_documents(docs, items).collect()} == {2, 4}
    assert decontaminate.benchmark_hits(odd, items).count() == 8
    assert decontaminate.benchmark_hits(odd, items.limit(0)).where("contaminated").count() == 0


def test_windows_of_several_passes_are_those_of_one(spark):
    passage = "One, two, three. four -b 5, caf\u00e9; six-seven, EIGHT. nine, ten"
    docs = spark.createDataFrame(
        [(1, f"x, {passage}. y"), (2, "so, few. few, WORDS -b other"), (2, "so, few. few, WORDS -b other"), (None, f"\u00e9, {passage}"), (5, None)], DOCS)
    items = spark.createDataFrame([(1, passage), (2, "so, few"), (3, "few, words"), (4, "three, FOUR. -b")], "item_id bigint, text string")

    def found(part_bytes):
        got = decontaminate.benchmark_hits(docs, items, part_bytes=part_bytes)
        return got.schema["spans"].dataType, sorted(map(repr, got.collect()))

    assert len(decontaminate.benchmark_parts(items, 10)) > 1
    assert found(10) == found(1 << 20)
    hits = {r.doc_id: r.n_hit for r in decontaminate.benchmark_hits(docs, items, part_bytes=10).collect()}
    assert hits == {1: 12, 2: 4, None: 12, 5: 0}


def test_shards_are_even_and_copies_stay_together(spark, odd):
    rows = [(i, f"text {i}" if i % 3 else f"copy {i // 30}") for i in range(300)]
    got = shards.shard_documents(spark.createDataFrame(rows, DOCS), shards=7).collect()
    counts = np.bincount([r.shard for r in got])
    assert len(got) == 300 and counts.max() - counts.min() <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    home = {}
    for r in got:
        if r.doc_id % 3 == 0:
            home.setdefault(r.doc_id // 30, set()).add(r.shard)
    assert sum(len(x) == 1 for x in home.values()) >= 8
    assert len(shards.shard_documents(odd, shards=3).collect()) == 8


def test_copies_stay_together_where_all_rows_have_some(spark):
    rows = [(i, f"copy {i // 3}") for i in range(600)]
    got = shards.shard_documents(spark.createDataFrame(rows, DOCS), shards=6).collect()
    assert set(np.bincount([r.shard for r in got])) == {100}
    home = {}
    for r in got:
        home.setdefault(r.doc_id // 3, []).append(r.shard)
    assert sum(len(set(x)) == 1 for x in home.values()) >= 160


def test_a_group_of_a_third_takes_few_shards(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(600)]
    got = shards.shard_documents(spark.createDataFrame(rows, DOCS), shards=12).collect()
    assert set(np.bincount([r.shard for r in got])) == {50}
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) == 4


def test_jaccard_components_equal_brute_force(spark, odd):
    rnd = random.Random(4)
    texts = []
    for _ in range(12):
        base = words(rnd, rnd.choice([3, 7, 12, 40, 80]), 60).split()
        for _ in range(rnd.randrange(1, 9)):
            copy = list(base)
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(1000)}"
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, " ")]

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in sets}
    # of the two long texts and of the two sentences one each goes; texts without words stay
    assert jaccard.one_of_each(odd).count() == 6


def test_jaccard_of_one_hot_group_with_members_apart(spark):
    rnd = random.Random(8)
    base = words(rnd, 110, 5000).split()
    texts = [base]
    for k in range(260):  # copies of the base, and of copies, beyond the threshold as well
        copy = list(base if k % 3 else rnd.choice(texts))
        for _ in range(rnd.randrange(1, 9)):
            copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(6)}"
        texts.append(copy[: rnd.choice([110, 110, 104])] + ["more"] * rnd.choice([0, 0, 3]))
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 75 * len(x | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 20 < len(set(root)) < 200
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == dict(enumerate(root))


def test_repeated_strings_equal_brute_force(spark, odd):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = [(1, base), (2, base[100:400] + "é" + base[:250]), (3, "ab" * 200), (4, base[5:90]), (None, base[300:500]), (6, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    seen = set()
    for i, t in sorted(rows, key=lambda r: r[0] or 0):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert got[i] == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffixes.without_repeats(odd).count() == 8


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(spark, odd, bits):
    path = public_tokenizers.path("word_bpe_49k.json")
    records = stored(planes.encode_records(odd, path, 2, bits=bits, block=1000), "records")
    got = planes.read_documents(records, bits).orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (start, len(ids) // 4, ids, zlib.crc32(ids))
        start += r.n_tokens
    assert len(got) == 8


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_letters_that_become_several_words(name):
    path = public_tokenizers.path(name)
    tokenizer, encoder = Tokenizer.from_file(path), Encoder(path)
    texts = ["an alpha \u0130stanbul beta gamma", "x a\u09dfb c\u095cd \u0958 end", None, "", "le na\u00efve caf\u00e9 plain words"]
    ids, at = encoder.ids(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_languages_of_documents_and_spans(spark, odd, none):
    a, b = "the house and the garden over there", "das haus und der garten dort drüben"
    rows = [(i, a if i % 2 else b, "en" if i % 2 else "de") for i in range(20)]
    model = language.learn(spark.createDataFrame(rows, DOCS + ", lang string"))
    df = spark.createDataFrame([(1, f"{a} {a} {b}"), (2, "12 !"), (3, None), (4, b)], DOCS)
    got = {r.doc_id: r for r in language.identify(df, model, spans=True, penalty=3.0).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "und", "und", "de"]
    assert [s.lang for s in got[1].spans] == ["en", "de"]
    found = language.identify(odd, model).collect()
    assert len(found) == 8 and all(0 <= r.score <= 1 for r in found)
    assert language.learn(none) is None and language.identify(odd, None).where("lang_pred != 'und'").count() == 0


def test_word_scores_are_the_same_in_any_slices(monkeypatch):
    rnd = np.random.default_rng(7)
    sizes = (language.GRAMS, language.WORDS, len(language._NAMES))
    model = language.Model(["a", "b"], *[rnd.random((2, n)) * 9 for n in sizes])
    texts = ["one two", None, "", "12 !", "drei vier fünf", "шесть", "x" * 50]
    part = pa.record_batch([pa.array(texts)], names=["_text"])
    whole = language._word_scores(part, model)
    monkeypatch.setattr(language, "LETTER_BYTES", 8)
    for a, b in zip(whole, language._word_scores(part, model)):
        assert np.array_equal(a, b)
    assert whole[4].tolist() == [2, 0, 0, 0, 3, 1, 1]


def test_viterbi_equals_the_best_path():
    rnd = np.random.default_rng(6)
    scores, first = rnd.normal(size=(9, 3)).astype(np.float32) * 3, np.array([0, 5, 5, 9])
    got = language.viterbi(scores, first, 2.0)
    import itertools
    for a, b in ((0, 5), (5, 9)):
        def worth(p):
            return sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=b - a), key=worth)
        assert worth(tuple(got[a:b])) == pytest.approx(worth(best))


def test_packing_loses_nothing(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(odd, path, 0, capacity=64).collect()
    tokenizer, texts = Tokenizer.from_file(path), [r.text or "" for r in odd.collect()]
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(r.length for r in got) == total
    fills = {}
    for r in got:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fills.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    assert packing.pack(odd.limit(0), path, 0).count() == 0


def test_runs_pack_every_length_closely():
    rnd = random.Random(7)
    histogram = {n: rnd.randrange(1, 60) for n in range(1, 500, 3)}
    runs, bins = packing.plan_runs(histogram, 500)
    counts = {}
    for n, _, c, _, _ in runs:
        counts[n] = counts.get(n, 0) + c
    assert counts == histogram
    # best-fit decreasing on every single length, without grouping
    gaps, plain = [], 0
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(gaps, n)
        plain += at == len(gaps)
        rest = (gaps.pop(at) if at < len(gaps) else 500) - n
        bisect.insort(gaps, rest)
    assert bins <= 1.01 * plain
