"""Words and pairs of neighbouring words as numbered features, counted in vectorised steps.

The features are the most frequent words and pairs. A pair occurs no more often than
either of its words, so pairs that are among the most frequent terms consist of words that
occur more often than the last word of as many words alone: words are counted first, and
then only pairs of those. Nothing is estimated. Words are cut and numbered in Python, one
step of some texts at a time; the JVM's expressions for them take ten times as long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import post_text
from ..sources.storage import stored
from .vocabulary import found

#: Lower-cased words of two and more letters, digits and underscores: those of vocabulary.TOKEN.
WORD = re.compile(r"\w{2,}")
#: Distinct words or pairs that a task holds before it hands them on, and bytes of the texts of a step; a longer text is a step of its own.
HELD, TEXT = 1 << 20, 1 << 21


def steps(column: pa.Array) -> Iterator[pa.Array]:
    """Texts in turn, as many as have so many bytes."""
    ends = np.concatenate([[0], pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)])
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TEXT, "right")) - 1)
        yield column.slice(at, to - at)
        at = to


def coded(texts: pa.Array, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and number of each word, -1 for one that is not known, and where a pair of known words begins)."""
    every, sizes = [], []
    for text in texts.to_pylist():
        own = WORD.findall((text or "").lower())
        every += own
        sizes.append(len(own))
    code = np.fromiter(map(place.get, every, repeat(-1)), np.int64, len(every))
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, code, np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))


def single_words(rows: DataFrame) -> DataFrame:
    """w, n: how often each word occurs in rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            yield from pa.table([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["w", "n"]).to_batches(1 << 16)

        for batch in batches:
            for text in batch.column("text"):
                n.update(WORD.findall((text.as_py() or "").lower()))
                if len(n) > HELD:
                    yield from out()
                    n.clear()
        yield from out()

    return rows.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their numbers."""
    key, own = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(own, np.concatenate(n), len(key)).astype(np.int64)


def pairs(rows: DataFrame, known: list[str]) -> DataFrame:
    """key, n: how often pairs of known words occur; a key is first * len(known) + second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys, n, size = {w: i for i, w in enumerate(known)}, [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            yield from pa.table([pa.array(keys[0]), pa.array(n[0])], names=["key", "n"]).to_batches(1 << 16)

        for part in (x for batch in batches for x in steps(batch.column("text"))):
            _, code, near = coded(part, place)
            each = np.unique(code[near] * len(known) + code[near + 1], return_counts=True)
            keys, n, size = [*keys, each[0]], [*n, each[1]], size + len(each[0])
            if size > 2 * HELD:
                keys, n = ([x] for x in summed(keys, n))
                size = len(keys[0])
                if size > HELD:
                    yield from out()
                    keys, n, size = [], [], 0
        if keys:
            keys, n = ([x] for x in summed(keys, n))
            yield from out()

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def most_frequent(rows: DataFrame, n: int) -> list[str]:
    """The n most frequent words and pairs of rows (text); of equal ones words come first, then by name."""
    single = [tuple(r) for r in single_words(rows).orderBy(F.desc("n"), "w").limit(n).collect()]  # bounded
    least = single[-1][1] if len(single) == n else 0
    known = sorted(w for w, c in single if c > least)
    more = pairs(rows, known).filter(F.col("n") > least).orderBy(F.desc("n"), "key").limit(n).collect() if known else []
    every = [(-c, False, (w,)) for w, c in single] + [(-r["n"], True, (known[r["key"] // len(known)], known[r["key"] % len(known)])) for r in more]
    return [" ".join(x) for _, _, x in sorted(every)[:n]]


@dataclass
class Terms:
    """Features by number: words and pairs with their idf."""

    names: list[str]
    idf: np.ndarray
    words: list[str]
    #: Number of the feature that a word is, -1 for none; of each pair, whose keys are sorted.
    single: np.ndarray
    pairs: np.ndarray
    paired: np.ndarray

    @classmethod
    def of(cls, names: list[str], idf: np.ndarray) -> Terms:
        parts = [x.split(" ") for x in names]
        known = sorted({w for p in parts for w in p})
        place = {w: i for i, w in enumerate(known)}
        single = np.full(len(known) + 1, -1)  # the last is that of words that are not known
        for i, p in enumerate(parts):
            if len(p) == 1:
                single[place[p[0]]] = i
        two = sorted((place[p[0]] * len(known) + place[p[1]], i) for i, p in enumerate(parts) if len(p) == 2)
        return cls(names, idf, known, single, np.array([k for k, _ in two], np.int64), np.array([i for _, i in two] + [-1], np.int64))

    @cached_property
    def place(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, times) of the features of each text, by row and feature."""
        row, code, near = coded(texts, self.place)
        both = self.paired[found(self.pairs, code[near] * len(self.words) + code[near + 1])]
        term, row = np.concatenate([self.single[code], both]), np.concatenate([row, row[near]])
        some, width = term >= 0, max(1, len(self.names))
        key, times = np.unique(row[some] * width + term[some], return_counts=True)
        return key // width, key % width, times

    def weights(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(the value of each count, the length of each of n rows by which it was divided; 1 for a row without a feature)."""
        x = times * self.idf[term]
        norm = np.sqrt(np.bincount(row, x * x, n))
        norm[norm == 0] = 1
        return x / norm[row], norm

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows (title, desc) with `features` as a sparse vector; fits do not need it."""
        size = len(self.names)

        def run(column: pa.Array) -> pa.Array:
            row, term, times = self.counts(column)
            x, _ = self.weights(row, term, times, len(column))
            ends = pa.array(np.searchsorted(row, np.arange(len(column) + 1)), pa.int32())
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(x))], names=["i", "x"])

        pair = F.arrow_udf(run, "i array<int>, x array<double>")
        vector = F.udf(lambda p: SparseVector(size, p["i"], p["x"]), VectorUDT())
        return df.withColumn("features", vector(pair(post_text())))


def encoded(rows: DataFrame, terms: Terms) -> DataFrame:
    """h, y, term, times: rows (h, y, text) with their features as 16-bit and how often they occur as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in steps(batch.column("text")):
                row, term, times = terms.counts(part)
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                packed = [pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in (term.astype(np.uint16), times.astype(np.uint32))]
                yield pa.record_batch([*(batch.column(c).slice(at, len(part)) for c in ("h", "y")), *packed], names=["h", "y", "term", "times"])
                at += len(part)

    return rows.mapInArrow(run, "h long, y int, term binary, times binary")


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all rows of a packed column, one row after the other."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column if len(x.as_buffer()))])


def features(rows: DataFrame, max_features: int) -> tuple[Terms, DataFrame]:
    """(TF-IDF features of rows (h, y, text), the rows encoded by them): idf ln((1 + n) / (1 + df)) + 1, rows scaled to length 1."""
    if max_features > 1 << 16:
        raise ValueError(f"at most {1 << 16} features")
    names = most_frequent(rows, max_features)
    plain = Terms.of(names, np.ones(len(names)))
    made = stored(encoded(rows, plain), "encoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(names), np.int64), 0
        for batch in batches:
            df, n = df + np.bincount(unpacked(batch.column("term"), np.uint16), minlength=len(names)), n + batch.num_rows
        yield pa.record_batch([pa.array([n]), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])

    each = made.select("term").coalesce(parts(made)).mapInArrow(run, "n long, df binary").collect()  # a row for each task
    n, df = sum(r["n"] for r in each), sum((np.frombuffer(r["df"], np.int64) for r in each), np.zeros(len(names), np.int64))
    return Terms.of(names, np.log((1.0 + n) / (1.0 + df)) + 1), made


def parts(df: DataFrame) -> int:
    """Tasks whose sums a driver adds: as many as run at once, up to a number that bounds what it holds."""
    return max(1, min(16, df.sparkSession.sparkContext.defaultParallelism))
