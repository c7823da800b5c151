"""TF-IDF over a bounded vocabulary that is found without shuffling every term.

Each task keeps a summary of its heavy hitters, a bounded number of counters: when there
are too many, all lose what the next one had, and the smaller ones go. Summaries merge by
adding; what all of them took off is the bound of the error. The largest merged counters
are candidates, which a second pass counts exactly. If the last term of the vocabulary
that this gives occurs more often than the bound and the first counter left out together
allow a missed term to, no term was missed; else the summaries get more counters, and in
the end every term is counted. Weights are made in a third pass, within each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Counters of a summary, in turn; beyond the last every term is counted.
COUNTERS = (200_000, 1_600_000)
#: Candidates for each term of the vocabulary, since some have too few or too many rows.
SPARE = 8
#: Words of the rows that one vectorised step handles; a longer row is a step of its own.
STEP_WORDS = 1 << 18


def tokens(df: DataFrame, text: Column) -> DataFrame:
    """pos, w: the lower-cased words of two and more letters of each row."""
    return df.select("pos", F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1).alias("w"))


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_WORDS) -> Iterator[pa.RecordBatch]:
    """The batches cut where the words in `w` reach `limit`; no row is cut."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of words as the first or only word of a term, and as its second."""
    h = pd.util.hash_array(np.array(words, object)) if words else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return h * np.uint64(0xBF58476D1CE4E5B9), (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)


def term_hashes(terms: list[list[str]]) -> np.ndarray:
    """Hashes of terms of one or two words, as batches have them."""
    first, second = word_hashes([t[0] for t in terms])[0], word_hashes([t[-1] for t in terms])[1]
    return first ^ np.where(np.array([len(t) for t in terms], np.int64) > 1, second, np.uint64(0))


class Batch:
    """The occurrences of terms in a batch's rows: words, then pairs of neighbours, each with its row and a hash."""

    def __init__(self, column: pa.Array, bigrams: bool) -> None:
        flat = column.flatten().dictionary_encode()
        code, self.words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
        sizes = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.first, self.second, self.row = code, np.full(len(code), -1), row
        if bigrams:
            near = np.flatnonzero(row[1:] == row[:-1])
            self.first, self.second, self.row = np.concatenate([code, code[near]]), np.concatenate([self.second, code[near + 1]]), np.concatenate([row, row[near]])
        one, two = word_hashes(self.words)
        self.hash = one[self.first] ^ np.append(two, np.uint64(0))[self.second]

    def terms(self, at: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(number of the term of each of the occurrences `at`, the distinct terms)."""
        width = len(self.words) + 1
        keys, own = np.unique(self.first[at] * width + self.second[at] + 1, return_inverse=True)
        pairs = zip((keys // width).tolist(), (keys % width - 1).tolist(), strict=True)
        return own, [self.words[a] if b < 0 else f"{self.words[a]} {self.words[b]}" for a, b in pairs]


class Summary:
    """Counters of heavy hitters by hash; a term that has none occurred `taken` times at most.

    What is added waits until it is as long as the counters, so that many small steps
    cost no sort of all counters each.
    """

    def __init__(self, counters: int) -> None:
        self.counters, self.taken = counters, 0
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((keys, n))
        if sum(len(k) for k, _ in self.waiting) >= self.counters:
            self.merge()

    def merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip((self.keys, self.n), *self.waiting, strict=True))
        self.waiting = []
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n
        if len(self.keys) > self.counters:
            less = int(np.partition(self.n, -self.counters - 1)[-self.counters - 1])
            self.n -= less
            self.keys, self.n = self.keys[self.n > 0], self.n[self.n > 0]
            self.taken += less


def candidates(words: DataFrame, bigrams: bool, counters: int, wanted: int) -> tuple[np.ndarray, int]:
    """(sorted hashes of at most `wanted` terms, how often any other term occurs at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Summary(counters)
        for batch in steps(batches):
            each = pc.value_counts(pa.array(Batch(batch.column("w"), bigrams).hash))
            own.add(each.field("values").to_numpy(), each.field("counts").to_numpy())
        own.merge()
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([own.taken], pa.int64())], names=["key", "n"])
        yield from pa.table([pa.array(own.keys.view(np.int64)), pa.array(own.n, pa.int64())], names=["key", "n"]).to_batches(10_000)

    merged = stored(words.select("w").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "summary")
    taken = merged.filter("key IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = merged.filter("key IS NOT NULL").orderBy(F.desc("n"), "key").limit(wanted + 1).collect()
    left_out = top[wanted]["n"] if len(top) > wanted else 0
    return np.sort(np.array([r["key"] for r in top[:wanted]], np.int64).view(np.uint64)), taken + left_out


def counted(words: DataFrame, bigrams: bool, among: np.ndarray | None) -> DataFrame:
    """term, total, df of the terms whose hash is among the given ones, or of all."""
    shared = None if among is None else words.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            b = Batch(batch.column("w"), bigrams)
            at = np.arange(len(b.hash)) if shared is None else np.flatnonzero(found(shared.value, b.hash) >= 0)
            own, terms = b.terms(at)
            df = np.bincount(np.unique(own * batch.num_rows + b.row[at]) // batch.num_rows, minlength=len(terms))
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array(np.bincount(own, minlength=len(terms))), pa.array(df)], names=["term", "total", "df"])

    return words.select("w").mapInArrow(run, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 for none."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def vocabulary(words: DataFrame, n: int, max_features: int, min_df: int = 1, max_df: float = 1.0, bigrams: bool = True, counters: tuple[int, ...] = COUNTERS) -> list[tuple[str, int, int]]:
    """(term, total, df) of the `max_features` most frequent terms, equal ones by name, among those with an allowed number of rows."""
    allowed = (F.col("df") >= min_df) & (F.col("df") <= max_df * n)
    top = lambda terms: [tuple(r) for r in terms.filter(allowed).orderBy(F.desc("total"), "term").limit(max_features).collect()]  # noqa: E731  bounded
    for size in counters:
        keys, missed = candidates(words, bigrams, size, min(size, SPARE * max_features))
        best = top(counted(words, bigrams, keys))
        if not missed or len(best) == max_features and best[-1][1] > missed:
            return best
    return top(counted(words, bigrams, None))


def tfidf(df: DataFrame, text: Column, max_features: int, min_df: int = 1, max_df: float = 1.0, bigrams: bool = True, counters: tuple[int, ...] = COUNTERS) -> DataFrame:
    """pos, term, w: smooth idf ln((1 + n) / (1 + df)) + 1, rows scaled to length 1; a row is a document."""
    words = stored(tokens(df, text), "tokens")
    n = words.count()
    known = vocabulary(words, n, max_features, min_df, max_df, bigrams, counters)
    idf = {t: np.log((1.0 + n) / (1.0 + d)) + 1 for t, _, d in known}
    hashes = np.sort(term_hashes([t.split(" ") for t in idf]))
    shared = df.sparkSession.sparkContext.broadcast((idf, hashes))
    pos = df.schema["pos"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, hashed = shared.value
        for batch in steps(batches):
            b = Batch(batch.column("w"), bigrams)
            at = np.flatnonzero(found(hashed, b.hash) >= 0)
            own, terms = b.terms(at)
            weight = np.fromiter((idf.get(t, 0.0) for t in terms), np.float64, len(terms))
            some = weight[own] > 0  # a term that only shares a hash has none
            size = max(1, len(terms))
            keys, tf = np.unique(b.row[at][some] * size + own[some], return_counts=True)
            row, term = keys // size, keys % size
            x = tf * weight[term]
            norm = np.sqrt(np.bincount(row, x * x, batch.num_rows))
            yield pa.record_batch([batch.column("pos").take(pa.array(row)), pa.array(terms, pa.string()).take(pa.array(term)), pa.array(x / norm[row])], names=["pos", "term", "w"])

    return words.mapInArrow(run, f"pos {pos}, term string, w double")
