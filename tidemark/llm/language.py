"""Language identification: script ranges, per-word scores, and a Viterbi path.

Each word gets one score per language: the mean log-probability of its hashed character
n-grams under that language. The script of its letters narrows the languages to those
seen in that script. The Viterbi path over the words of a text, with a penalty for each
switch, labels spans of mixed-language text; the language with most letters is the
prediction, its share of the letters the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_of, slices, text_of
from .quality import Words, char_grams, gram_means

#: Labelled documents of each language that are learned from: those with the smallest hashes of id and text.
FIT_DOCS = 400
DIM = 1 << 16
SWITCH = 12.0
#: No word counts more than this against a language.
MOST = 6.0
#: A language has a script if this share of its letters is in it.
SCRIPT_SHARE = 0.02
#: First code points of script ranges, with the script that begins there (fixed values).
SCRIPTS = [(0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "other"), (0x900, "Devanagari"), (0x980, "Indic"), (0xE00, "Thai"), (0xE80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han")]
NAMES = sorted({s for _, s in SCRIPTS})
STARTS = np.array([a for a, _ in SCRIPTS])
KINDS = np.array([NAMES.index(s) for _, s in SCRIPTS])


def scripts_of(distinct: pa.Array) -> np.ndarray:
    """Script number of each word's first letter, -1 without one."""
    first = np.fromiter((next((ord(c) for c in x if c.isalpha()), -1) for x in distinct.to_pylist()), np.int64, len(distinct))
    return np.where(first < 0, -1, KINDS[np.searchsorted(STARTS, first, "right") - 1])


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (DIM, languages)
    scripts: np.ndarray  # (scripts, languages)

    def word_scores(self, distinct: pa.Array, script: np.ndarray) -> np.ndarray:
        letters = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
        out = gram_means(distinct, self.scores) * np.minimum(letters, 12)[:, None]
        out = np.maximum(out - out.max(1, keepdims=True), -MOST)
        allowed = self.scripts[script]
        allowed |= ~allowed.any(1, keepdims=True)
        out[~allowed] = -4 * MOST
        out[script < 0] = 0.0
        return out


def _counts(w: Words, doc_lang: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts and script counts of each language."""
    word_lang = doc_lang[doc_of(w.offsets)]
    each = [(owner, (grams % np.uint64(DIM)).astype(np.int64)) for owner, grams in char_grams(w.distinct)]
    script = scripts_of(w.distinct)
    tables, kinds = [], []
    for j in range(n_langs):
        times = np.bincount(w.codes[word_lang == j], minlength=len(w.distinct))
        tables.append(sum(np.bincount(at, times[owner], DIM) for owner, at in each))
        kinds.append(np.bincount(script[script >= 0], times[script >= 0], len(NAMES)))
    return np.array(tables), np.array(kinds)


def sample(known: DataFrame, docs_per_lang: int) -> DataFrame:
    """lang, h of at most `docs_per_lang` distinct rows of each language: those with the smallest hashes `h` of id and text.

    The number of distinct hashes, which is estimated, gives each language a share of all
    hashes that holds about twice as many, so only those are ranked, however many rows a
    language has; its smallest hash is always among them.
    """
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least"))
    place = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    # a row for each language, of which the model holds a whole column
    near = known.select("lang", "h").join(F.broadcast(counts), "lang").filter((place * F.col("n") <= 2 * docs_per_lang + 20) | (F.col("h") == F.col("least")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return near.select("lang", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= docs_per_lang).drop("rank")


def fit(docs: DataFrame, docs_per_lang: int = FIT_DOCS) -> Model:
    """Learn from the text and lang of `docs`; rows where either, or the id, is null are left out.

    Rows with one id and different texts are learned one by one; a repeated row is
    learned once. The bounded sample is joined to the texts before they go to Python.
    """
    spark = docs.sparkSession
    known = docs.filter("lang is not null and text is not null and doc_id is not null").select("text", "lang", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h"))
    chosen = [tuple(r) for r in sample(known, docs_per_lang).collect()]
    langs = sorted({lang for lang, _ in chosen})
    if not langs:
        return Model([], np.zeros((DIM, 0)), np.zeros((len(NAMES), 0), bool))
    number = {x: i for i, x in enumerate(langs)}
    wanted = spark.createDataFrame([(h, lang, number[lang]) for lang, h in chosen], "h long, lang string, number int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = kinds = None
        for part in slices(batches, "text"):
            more, found = _counts(Words.of(text_of(part.column("text"))), part.column("number").to_numpy(), len(langs))
            tables, kinds = (more, found) if tables is None else (tables + more, kinds + found)
        if tables is not None:
            for j in range(len(langs)):
                at = np.flatnonzero(tables[j])
                yield pa.record_batch([pa.array([j], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([tables[j][at].astype(np.float32).tobytes()], pa.binary()), pa.array([kinds[j].astype(np.float64).tobytes()], pa.binary())], names=["lang", "at", "n", "scripts"])

    sums, kinds = np.zeros((DIM, len(langs))), np.zeros((len(NAMES), len(langs)))
    for row in known.join(F.broadcast(wanted), ["h", "lang"]).dropDuplicates(["h", "lang"]).select("text", "number").mapInArrow(run, "lang int, at binary, n binary, scripts binary").toLocalIterator():
        sums[np.frombuffer(row["at"], np.int32), row["lang"]] += np.frombuffer(row["n"], np.float32)
        kinds[:, row["lang"]] += np.frombuffer(row["scripts"], np.float64)
    share = (sums + 0.5) / (sums.sum(0) + 0.5 * DIM)
    return Model(langs, np.log(share), kinds > SCRIPT_SHARE * np.maximum(1, kinds.sum(0)))


def viterbi(scores: np.ndarray, codes: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; texts advance in step, the longest first."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    starts, n = offsets[:-1][order], n[order]
    active = len(n) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), "right")
    labels = scores.shape[1]
    kind = np.uint8 if labels <= 256 else np.int32
    back = np.empty((len(codes), labels), kind)
    best = np.zeros((len(n), labels))
    own = np.arange(labels, dtype=kind)
    for t, a in enumerate(active.tolist()):
        at, v = starts[:a] + t, best[:a]
        top = v.argmax(1)
        jump = v[np.arange(a), top] - switch
        stay = v >= jump[:, None]
        back[at] = np.where(stay, own, top[:, None].astype(kind))
        best[:a] = np.where(stay, v, jump[:, None]) + scores[codes[at]]
    path = np.empty(len(codes), kind)
    state = best.argmax(1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        a = int(active[t])
        at = starts[:a] + t
        path[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return path


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans (in word numbers, end exclusive); one row for each row.

    `und` with score 0 where the text is null or has no letter, or nothing was learned.
    Ties go to the language that comes first by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for part in slices(batches, "text", 8 << 20):
            w = Words.of(text_of(part.column("text")))
            rows = part.num_rows
            script = scripts_of(w.distinct)
            letters = np.where(script >= 0, pc.utf8_length(w.distinct).to_numpy(zero_copy_only=False), 0)
            if m.langs and len(w.codes):
                path = viterbi(m.word_scores(w.distinct, script), w.codes, w.offsets, switch)
                doc = doc_of(w.offsets)
                weight = np.bincount(doc * len(m.langs) + path.astype(np.int64), letters[w.codes], rows * len(m.langs)).reshape(rows, -1)
                first = np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])])
                at = np.flatnonzero(first)
                base = w.offsets[doc[at]]
                ends = np.append(at[1:], len(path)) - base
                spans = pa.StructArray.from_arrays([pa.array(at - base), pa.array(ends), pa.array(names[path[at]], pa.string())], fields=list(SPAN))
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=rows))])
            else:
                weight = np.zeros((rows, max(1, len(m.langs))))
                spans, cuts = pa.array([], SPAN), np.zeros(rows + 1, np.int64)
            total = weight.sum(1)
            best = np.where(total > 0, weight.argmax(1), len(m.langs))
            score = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)
            yield pa.record_batch([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")
