"""Spelling variants: words one code point apart, grouped under their most frequent form.

Words that differ by one inserted, deleted or replaced code point lose at most two of
their bigrams. Bigrams are ordered from rare to frequent over all words, those of a word
that are equal by their places; among its first three at least one outlives the edit, and
the first that does is the same bigram in both words, at the same place if one letter is
replaced, and else at the same place or one later in the longer word. So only the three
rarest bigrams of each word are joined, on bigram, place and length, and an exact edit
distance decides.

Letters of words are Latin-1, so there are at most 8100 bigrams, whatever the corpus. A
join key that more than a thousandth of all entries have is cut in parts by the hash of
the word; there are fewer than a thousand such keys.

Rows: null text has no words, a null id is written as nothing before the colon, a
repeated row counts again, texts and words have any length, an empty table gives no rows,
and further columns are not looked at. Ties of frequency go to the word that comes first
in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, MIX_A, coded, doc_of, drop_dir, mixed, shared_dir, slices, stored, text_of, words_of

#: A run loses a letter where this divides its hash; code points and occurrences that a word needs; how often a form is as frequent (fixed values).
DROPPED, MIN_LETTERS, MIN_COUNT, TIMES = 97, 5, 3, 2
PREFIX = 3


def runs_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case) as of `words_of`."""
    _, offsets, data = texts.buffers()
    if data is None:
        return words_of(texts)
    b = np.frombuffer(data, np.uint8)
    lead = b == 0xC3  # of just these code points in UTF-8
    upper = (b >= 65) & (b <= 90)
    keep = upper | ((b >= 97) & (b <= 122)) | lead
    keep[1:] |= lead[:-1]
    out = np.where(keep, b + np.where(upper, np.uint8(32), np.uint8(0)), np.uint8(32))
    return words_of(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(out.tobytes())], offset=texts.offset))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words with their occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            offsets, runs = runs_of(text_of(part.column("text")))
            codes, distinct = coded(runs)
            letters = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
            doc = doc_of(offsets)
            long = letters[codes] >= MIN_LETTERS
            size = max(1, len(distinct))
            keys, times = np.unique(doc[long] * size + codes[long], return_counts=True)
            own, word = keys // size, keys % size
            starts = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column("doc_id").to_pylist()]
            raw = distinct.cast(pa.binary()).to_pylist()
            h = np.fromiter((zlib.crc32(raw[w], starts[d]) for d, w in zip(own.tolist(), word.tolist(), strict=True)), np.int64, len(keys))
            less = h % DROPPED == 0
            n = np.bincount(word[~less], times[~less], len(distinct)).astype(np.int64)
            cut: Counter[str] = Counter()
            text = distinct.take(pa.array(word[less])).to_pylist()
            for w, k, m in zip(text, h[less].tolist(), times[less].tolist(), strict=True):
                if len(w) > MIN_LETTERS:
                    k %= len(w)
                    cut[w[:k] + w[k + 1 :]] += m
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.concat_arrays([distinct.take(pa.array(at)), pa.array(list(cut), pa.string())]), pa.array(np.concatenate([n[at], np.fromiter(cut.values(), np.int64, len(cut))]))], names=["word", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


class Letters:
    """Words as Latin-1 bytes and their bigrams."""

    def __init__(self, words: pa.Array) -> None:
        raw = "\n".join([*words.to_pylist(), ""]).encode("latin-1")
        data = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero(data == 10)
        self.first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        self.size = ends - self.first
        at = np.flatnonzero((data[:-1] != 10) & (data[1:] != 10)) if len(data) else np.zeros(0, np.int64)
        self.gram = data[at].astype(np.int64) << 8 | data[at + 1]
        self.word = np.repeat(np.arange(len(self.size)), np.maximum(self.size - 1, 0))
        self.place = at - self.first[self.word]
        #: Letters of each word as bits, to tell far words apart at once.
        bits = np.uint64(1) << (data % 61).astype(np.uint64)
        bits[ends] = 0
        self.bits = np.bitwise_or.reduceat(bits, self.first).view(np.int64) if len(self.first) else np.zeros(0, np.int64)


def gram_ranks(words: DataFrame) -> np.ndarray:
    """A rank for each bigram, the rarest first, equal ones by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(Letters(batch.column("word")).gram, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for row in words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # 90 letters squared at most
        counts[row["gram"]] = row["n"]
    ranks = np.empty(1 << 16, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << 16)
    return ranks


ENTRY = "word string, n long, bits long, size int, key long, probe boolean"


def prefixes(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """The entries of each word: its three rarest bigrams with place and length, and the probes for words near it that are as long or longer.

    `key` is a hash of bigram, place and length; equal hashes of others only make candidates.
    """
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Letters(batch.column("word"))
            order = np.lexsort((x.place, shared.value[x.gram], x.word))
            nth = np.arange(len(order)) - np.searchsorted(x.word[order], x.word[order])
            order = order[nth < PREFIX]
            own, gram, place = x.word[order], x.gram[order].astype(np.uint64), x.place[order]
            size = x.size[own]

            def rows(shift: int, longer: int, probe: bool) -> pa.RecordBatch:
                with np.errstate(over="ignore"):
                    key = mixed(mixed(gram * MIX_A + (place + shift).astype(np.uint64)) * MIX_A + (size + longer).astype(np.uint64)).view(np.int64)
                return pa.record_batch([batch.column("word").take(pa.array(own)), batch.column("n").take(pa.array(own)), pa.array(x.bits[own]), pa.array((size + longer).astype(np.int32)), pa.array(key), pa.array(np.full(len(own), probe))], names=["word", "n", "bits", "size", "key", "probe"])

            yield rows(0, 0, False)
            yield rows(0, 0, True)
            yield rows(0, 1, True)
            yield rows(1, 1, True)

    return words.select("word", "n").mapInArrow(run, ENTRY)


def near_words(words: DataFrame, path: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """a, a_n, b, b_n: each two words one edit apart, once."""
    entries = stored(prefixes(words, gram_ranks(words)), f"{path}/entries")
    found = entries.filter("NOT probe")
    total = found.count()
    most = max(1, int(hot_share * total))
    hot = found.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
    hot = stored(hot.select("key", F.ceil(F.col("rows") / most).cast("int").alias("parts")), f"{path}/hot")
    parts = F.coalesce("parts", F.lit(1))
    side = lambda rows: rows.join(F.broadcast(hot), "key", "left")  # noqa: E731  fewer than 1 / hot_share keys
    left = side(entries.filter("probe")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    left = left.select("key", "part", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), F.col("size").alias("a_size"))
    right = side(found).withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    right = right.select("key", "part", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
    longer = F.length("a") < F.length("b")
    joined = left.join(right, ["key", "part"]).filter((longer | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2))
    return joined.filter(F.levenshtein("a", "b", 1) == 1).groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def roots(forms: DataFrame, path: str) -> DataFrame:
    """word, root: the last of the forms that a word leads to, by doubling; a form is at least twice as frequent, so chains are short."""
    now, step = stored(forms.select("word", F.col("form").alias("root")), f"{path}/0"), 0
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = stored(now.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), f"{path}/{step + 1}")
        drop_dir(forms.sparkSession, f"{path}/{step}")
        now, step = jumped.drop("moved"), step + 1
        if jumped.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row for each word.

    A word's form is the most frequent word near it, where that is at least twice as
    frequent; `root` is where forms lead to in the end, the word itself without one.
    """
    at = shared_dir(docs.sparkSession, "spelling")
    words = stored(word_counts(docs), f"{at}/words")
    pairs = stored(near_words(words, f"{at}/near", hot_share), f"{at}/pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    found = words.join(best, "word", "left")
    own = -F.col("best.n") >= TIMES * F.col("n")
    found = stored(found.select("word", F.when(own, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(own, -F.col("best.n")).alias("form_n")), f"{at}/forms")
    ends = roots(found.filter("form IS NOT NULL"), f"{at}/roots")
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
