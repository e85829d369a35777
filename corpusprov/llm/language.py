"""Language of documents and of spans inside them.

Letters make words; a word's script (from ranges of code points) narrows the candidates to
languages in which that script was learnt. Every candidate gets the log-likelihood of the
word's letter trigrams and of the word itself; Viterbi over the words of a document, with a
penalty for each switch, labels spans. The language with most letters names the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprov.llm.arrays import Substrings, runs, slices
from corpusprov.llm.tokens import give_back

GRAMS, WORDS = 1 << 17, 1 << 18
#: Bytes of the texts whose letters are held at once, and of those that Viterbi takes together,
#: which holds only scores of words; a longer text is taken alone.
LETTER_BYTES, VITERBI_BYTES = 1 << 19, 6 << 20
UNKNOWN = "und"

#: First code point and script; a script holds up to the next entry.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
]
_FROM = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


class Letters:
    """Words of letters of some texts, with what scores are made of."""

    def __init__(self, column: pa.Array):
        texts = [t or "" for t in column.to_pylist()]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.at = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        low = _letters()[points]
        self.start, self.end = runs(low > 0, self.at)
        self.first = np.searchsorted(self.start, self.at)
        word = np.repeat(np.arange(len(self.start)), self.end - self.start)
        place = np.flatnonzero(low)
        before = np.where(place == self.start[word], 0, low[np.maximum(place - 1, 0)])
        after = np.where(place == self.end[word] - 1, 0, low[np.minimum(place + 1, max(len(low) - 1, 0))])
        mix = before * np.uint64(0x9E3779B97F4A7C15) + low[place] * np.uint64(0xC2B2AE3D27D4EB4F)
        mix = (mix + after * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        self.gram = (mix >> np.uint64(64 - 17)).astype(np.int64)
        self.gram_start = np.r_[0, np.cumsum(self.end - self.start)][:-1]
        self.word = (Substrings(low).hashes(self.start, self.end) >> np.uint64(64 - 18)).astype(np.int64)
        self.script = _SCRIPT[np.searchsorted(_FROM, points[self.start], side="right") - 1]
        self.letters = self.end - self.start


def _counted(docs: DataFrame, langs: list[str]) -> DataFrame:
    """Counts of trigrams, words and scripts per language, one row per language and task."""
    index = {name: k for k, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        kinds = {"gram": GRAMS, "word": WORDS, "script": len(_NAMES)}
        out = {k: np.zeros((len(langs), n), np.float32) for k, n in kinds.items()}
        for batch in batches:
            for part in slices(batch, "text", LETTER_BYTES):
                x = Letters(part.column("text"))
                lang = np.array([index[v] for v in part.column("lang").to_pylist()], np.int64)
                own = np.repeat(lang, np.diff(x.first))
                for k, v, by in (("gram", x.gram, np.repeat(own, x.letters)), ("word", x.word, own), ("script", x.script, own)):
                    out[k] += np.bincount(by * kinds[k] + v, minlength=out[k].size).reshape(out[k].shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(langs)), pa.int32())]
            + [pa.array([r.tobytes() for r in out[k]], pa.binary()) for k in kinds], names=["lang", *kinds])

    return docs.mapInArrow(count, "lang int, gram binary, word binary, script binary")


def _added(counts: DataFrame) -> DataFrame:
    """Counts of all tasks, one row per language: a driver gets no more than the model."""
    def add(key, table):
        rows = table.to_pylist()
        sums = [sum(np.frombuffer(r[k], np.float32).astype(np.float64) for r in rows) for k in ("gram", "word", "script")]
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int32())] + [pa.array([s.astype(np.float32).tobytes()], pa.binary()) for s in sums],
            names=["lang", "gram", "word", "script"])

    return counts.groupBy("lang").applyInArrow(add, "lang int, gram binary, word binary, script binary")


class Model:
    def __init__(self, langs: list[str], gram: np.ndarray, word: np.ndarray, script: np.ndarray):
        def logs(c, smooth):
            return np.ascontiguousarray(np.log((c + smooth) / (c.sum(1, keepdims=True) + smooth * c.shape[1])).T.astype(np.float32))

        self.langs, self.gram, self.word = langs, logs(gram, 0.5), logs(word, 0.5)
        known = script > 0.001 * script.sum(1, keepdims=True)
        self.allowed = (known | ~known.any(0)).T  # script by language


def learn(labelled: DataFrame, per_lang: int = 3000, tasks: int = 16) -> Model | None:
    """Learn from ``text`` and ``lang``, at most about ``per_lang`` documents of a language.

    The sample is taken by a hash of the text, so it is the same in each run. Rows without
    text or language are left out. None without any row.
    """
    labelled = labelled.where("text is not null and lang is not null").select("text", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    every = F.create_map(*[F.lit(v) for k in langs for v in (k, -(-sizes[k] // per_lang))])
    sample = labelled.where(F.pmod(F.xxhash64("text"), every[F.col("lang")]) == 0)
    rows = _added(_counted(sample.coalesce(tasks), langs)).collect()  # a row of 1.5 MB a language
    rows.sort(key=lambda r: r["lang"])
    return Model(langs, *(
        np.array([np.frombuffer(r[k], np.float32) for r in rows], np.float64) for k in ("gram", "word", "script")))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; texts are the runs of words between ``first``'s entries.

    All texts take their steps together, longest texts first.
    """
    words, states = scores.shape
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    kind = np.int8 if states <= 128 else np.int32
    label = np.zeros(words, kind)
    if not words:
        return label
    back = np.zeros((words, states), kind)
    active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    own = np.arange(states, dtype=kind)
    best = scores[begin[: active[0]]].copy()
    ended: list[np.ndarray] = []
    for t in range(1, int(size[0])):
        n = active[t]
        if n < len(best):
            ended.append(best[n:])
            best = best[:n]
        top = best.argmax(1)
        jump = best[np.arange(n), top] - penalty
        stay = best >= jump[:, None]
        row = begin[:n] + t
        back[row] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, jump[:, None]) + scores[row]
    final = np.concatenate([best, *ended[::-1]])
    at = np.zeros(len(size), np.int64)
    at[: len(final)] = final.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = active[t]
        row = begin[:n] + t
        label[row] = at[:n]
        at[:n] = back[row, at[:n]]
    return label


def _word_scores(part: pa.RecordBatch, model: Model) -> tuple[np.ndarray, ...]:
    """Scores of the words of ``_text`` for each language, the words' letters, their start and
    end in their texts, and each text's number of words."""
    found = []
    for piece in slices(part, "_text", LETTER_BYTES):
        x = Letters(piece.column("_text"))
        size = np.diff(x.first)
        scores = np.zeros((0, len(model.langs)), np.float32)
        if len(x.start):
            scores = np.add.reduceat(model.gram[x.gram], x.gram_start, axis=0) + model.word[x.word]
            scores[~model.allowed[x.script]] = -1e4
        text = np.repeat(x.at[:-1], size)
        found.append((scores, x.letters, x.start - text, x.end - text, size))
    return tuple(map(np.concatenate, zip(*found)))


def identify(docs: DataFrame, model: Model | None, penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to documents, and spans as (start, end, lang) if asked.

    ``score`` is the share of a document's letters in spans of the language it is given.
    Null texts, texts without a letter, and all texts if nothing was learnt, are ``und``
    with score 0. Whole texts of any length count. Ties go to the first language by name.
    Rows keep their other columns, but for ones named like the added.
    """
    added = ["lang_pred", "score", *["spans"] * spans]
    names = [c for c in docs.columns if c not in added]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def found(part: pa.RecordBatch, model: Model | None) -> pa.StructArray:
        pred, share, places = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
        if model:
            scores, size, start, end, words = _word_scores(part, model)
            got = viterbi(scores, np.r_[0, np.cumsum(words)], penalty)
            n = len(model.langs)
            text = np.repeat(np.arange(part.num_rows), words)
            letters = np.bincount(text * n + got, size, part.num_rows * n).reshape(-1, n)
            top = letters.argmax(1)
            total = letters.sum(1)
            share = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
            pred = [model.langs[k] if t else UNKNOWN for k, t in zip(top, total)]
            if spans and len(got):
                new = np.flatnonzero(np.r_[True, (got[1:] != got[:-1]) | (text[1:] != text[:-1])])
                last = np.r_[new[1:], len(got)] - 1
                for a, b in zip(new.tolist(), last.tolist()):
                    places[text[a]].append({"start": int(start[a]), "end": int(end[b]), "lang": model.langs[got[a]]})
        out = [pa.array(pred, pa.string()), pa.array(share)] + [pa.array(places, pa.list_(struct))] * spans
        return pa.StructArray.from_arrays(out, names=added)

    def label(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column], ["_text"])
            parts = [found(part, sent.value) for part in slices(batch, "_text", VITERBI_BYTES)]
            yield pa.concat_arrays(parts or [found(batch, None)])
        give_back()  # an idle worker keeps what it holds for a minute

    schema = "lang_pred string, score double" + ", spans array<struct<start:bigint,end:bigint,lang:string>>" * spans
    # only the text goes to Python; not deterministic, so that a filter on the result doesn't work it out twice
    marked = F.arrow_udf(label, schema).asNondeterministic()(F.col("text"))
    held = docs.select(*[F.col(f"`{c}`") for c in names], marked.alias(added[0]))
    made = [F.col(added[0])[c].alias(c) for c in added]
    return held.select(*[F.col(f"`{c}`") for c in names], *made)
