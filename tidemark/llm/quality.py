"""Quality rules: fixed counts per text, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word unigrams, word bigrams and
character n-grams (1 to 4, inside words, with word ends), fitted to labelled quality
rows and calibrated by a second, two-parameter logistic fit on held-out rows. A text's
score is a mean over its words, so a batch needs one weight per distinct word and one
per word pair, and scoring is a few vectorised look-ups per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, byte_views, coded, doc_of, hashes, mixed, open_fs, shared_dir, slices, text_of, words_of

#: Text bytes scored at a time.
SCORED_BYTES = 2 << 20
#: Rows that training reads at a time.
PART_ROWS = 128
#: Hashed features.
DIM = 1 << 18
#: Labelled rows that the classifier is fitted to: those with the smallest hashes of their ids.
FIT_ROWS = 4000
#: A text whose calibrated probability of good quality is lower is rejected.
LEAST_PROBABILITY = 0.5
GRAMS = (1, 2, 3, 4)
#: Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8


def char_grams(distinct: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (word number, hash) of every character n-gram of distinct words, ends included."""
    points = np.frombuffer(("\n" + "\n".join(distinct.to_pylist()) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = points == 10
    word = np.cumsum(end) - 1
    for n in GRAMS:
        count = max(0, len(points) - n + 1)
        with np.errstate(over="ignore"):
            key, ok = np.full(count, n, np.uint64), np.ones(count, bool)
            for j in range(n):
                key = key * MIX_A + points[j : j + count]
                if n == 1 or 0 < j < n - 1:
                    ok &= ~end[j : j + count]
            if n == 2:
                ok &= ~(end[:count] & end[1 : 1 + count])
            ok &= word[:count] < len(distinct)
            yield word[:count][ok], mixed(key[ok])


def gram_means(distinct: pa.Array, table: np.ndarray) -> np.ndarray:
    """The mean over each word's n-grams of the rows of a table with a row for each hashed feature."""
    flat = table.reshape(len(table), -1)
    total, n = np.zeros((len(distinct), flat.shape[1])), np.zeros(len(distinct))
    for owner, grams in char_grams(distinct):
        at = (grams % np.uint64(len(table))).astype(np.int64)
        n += np.bincount(owner, minlength=len(distinct))
        for j in range(flat.shape[1]):
            total[:, j] += np.bincount(owner, flat[at, j], len(distinct))
    return (total / np.maximum(1, n)[:, None]).reshape(len(distinct), *table.shape[1:])


@dataclass
class Words:
    """A batch of texts as words."""

    offsets: np.ndarray
    codes: np.ndarray
    distinct: pa.Array
    hash: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        offsets, words = words_of(texts)
        codes, distinct = coded(words)
        return cls(offsets, codes, distinct, hashes(distinct))

    def pair_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each pair of neighbours."""
        doc = doc_of(self.offsets)
        same = doc[1:] == doc[:-1]
        h = self.hash[self.codes]
        with np.errstate(over="ignore"):
            return doc[1:][same], mixed(h[:-1] * MIX_A + h[1:])[same]

    def sums(self, per_distinct: np.ndarray) -> np.ndarray:
        """Sum over the words of each text of a value per distinct word."""
        return np.diff(np.concatenate([np.zeros(1, per_distinct.dtype), np.cumsum(per_distinct[self.codes])])[self.offsets])


def rule_counts(texts: pa.Array, w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text.

    Windows are compared by 64-bit hashes mixed with the text's number.
    """
    n = len(texts)
    out = {"n_words": np.diff(w.offsets), "word_chars": w.sums(pc.utf8_length(w.distinct).to_numpy(zero_copy_only=False).astype(np.int64))}
    starts, data = byte_views(w.distinct)
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS.encode())] = 1
    out["n_symbols"] = w.sums(np.diff(np.concatenate([[0], np.cumsum(symbol[data])])[starts]))
    lines = pc.split_pattern(texts, "\n")
    at = lines.offsets.to_numpy().astype(np.int64)
    line, kinds = coded(lines.flatten())
    doc = doc_of(at - at[0])
    full = pc.binary_length(pc.ascii_trim_whitespace(kinds)).to_numpy(zero_copy_only=False)[line] > 0
    keys = doc[full] * max(1, len(kinds)) + line[full]
    out["n_dup_lines"] = np.bincount(doc[full], minlength=n) - np.bincount(np.unique(keys) // max(1, len(kinds)), minlength=n)
    doc = doc_of(w.offsets)
    covered = np.zeros(len(w.codes), bool)
    if len(w.codes) >= WINDOW:
        with np.errstate(over="ignore"):
            h = w.hash[w.codes]
            for step in (1, 2, 4):
                h = mixed(h[:-step] * MIX_A + h[step:])
            inside = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :])
            h = mixed(h[inside] + doc[inside].astype(np.uint64) * MIX_A)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(len(w.codes) + 1, np.int64)
        np.add.at(edge, inside[twice], 1)
        np.add.at(edge, inside[twice] + WINDOW, -1)
        covered = np.cumsum(edge)[:-1] > 0
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.offsets])
    return out


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])


@dataclass
class Classifier:
    """Weights, and the calibration's slope and offset; without weights it accepts all."""

    weights: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, w: Words) -> np.ndarray:
        n = np.maximum(1, np.diff(w.offsets))
        weights, dim = self.weights, np.uint64(DIM)
        per_word = weights[w.hash % dim] + gram_means(w.distinct, weights)
        doc, pairs = w.pair_hash()
        return (w.sums(per_word) + np.bincount(doc, weights[pairs % dim], len(n))) / n

    def probability(self, w: Words) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(w.offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(w) + self.offset, -30, 30)))


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, values) of each text; their product with the weights is Classifier.raw."""
    dim = np.uint64(DIM)
    n = np.diff(w.offsets)
    owner, grams = (np.concatenate(x) for x in zip(*char_grams(w.distinct), strict=True))
    counts = np.bincount(owner, minlength=len(w.distinct))
    first = np.concatenate([[0], np.cumsum(counts)])
    order = np.argsort(owner, kind="stable")
    gram = (grams[order] % dim).astype(np.int64)
    doc, pairs = w.pair_hash()
    pair_at = np.searchsorted(doc, np.arange(len(n) + 1))
    out = []
    for i, size in enumerate(n.tolist()):
        codes = w.codes[w.offsets[i] : w.offsets[i + 1]]
        kinds, times = np.unique(codes, return_counts=True)
        reach = counts[kinds]
        rows = np.repeat(first[kinds] - np.cumsum(reach) + reach, reach) + np.arange(int(reach.sum()))
        near = (pairs[pair_at[i] : pair_at[i + 1]] % dim).astype(np.int64)
        index = np.concatenate([(w.hash[kinds] % dim).astype(np.int64), gram[rows], near])
        value = np.concatenate([times, np.repeat(times / np.maximum(1, reach), reach), np.ones(len(near))]) / max(1, size)
        index, place = np.unique(index, return_inverse=True)
        out.append((index.astype(np.int32), np.bincount(place, value, len(index)).astype(np.float32)))
    return out


def _descend(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression by AdaGrad, both classes weighing the same."""
    weights, seen = np.zeros(DIM), np.full(DIM, 1e-6)
    share = sum(y for *_, y in rows) / len(rows)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            index, value, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(weights[index] @ value, -30, 30)))
            slope = (p - y) * (0.5 / share if y else 0.5 / (1 - share)) * value + decay * weights[index]
            seen[index] += slope * slope
            weights[index] -= rate * slope / np.sqrt(seen[index])
    return weights


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, towards softened labels."""
    good = int(y.sum())
    goal = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    x = np.stack([raw, np.ones(len(raw))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -2, 2)
    return float(max(theta[0], 0.05)), float(theta[1])


def _trained(path: str) -> Classifier:
    """Fit to the rows of the files below `path`, a quarter of them for calibration."""
    fs, at = open_fs(path)
    files = sorted(f.path for f in fs.get_file_info(FileSelector(at)) if f.path.endswith(".parquet"))
    data = []
    for name in files:
        with fs.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(PART_ROWS, columns=["index", "value", "y"]):
                data += [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32), y) for i, v, y in zip(batch.column("index"), batch.column("value"), batch.column("y").to_pylist(), strict=True)]
    order = np.random.default_rng(7).permutation(len(data)).tolist()
    held, used = [data[i] for i in order[: len(data) // 4]], [data[i] for i in order[len(data) // 4 :]]
    if any(len({y for *_, y in part}) < 2 for part in (held, used)):
        held = used = data
    if len({y for *_, y in data}) < 2:
        return Classifier()
    weights = _descend(used)
    raw = np.array([weights[i] @ v for i, v, _ in held])
    slope, offset = _calibrate(raw, np.array([y for *_, y in held]))
    return Classifier(weights.astype(np.float32), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Fit to at most `rows` rows of labels (doc_id, quality 0 or 1), a quarter of them for calibration.

    Labels that are null or of no document are left out; without rows of both classes
    the classifier accepts all. Only the texts of these rows go to Python. Their features
    go to a shared folder, at most `DIM` of each, from which one task learns; the driver
    gets the weights.
    """
    spark = docs.sparkSession
    chosen = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = [tuple(r) for r in chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if not chosen:
        return Classifier()
    wanted = spark.createDataFrame(chosen, "doc_id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = features(Words.of(text_of(part.column("text"))))
            yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["doc_id", "y", "index", "value"])

    own = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(wanted), "doc_id")
    made = own.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, index binary, value binary")
    at = shared_dir(spark, "quality")
    made.repartition(1).sortWithinPartitions("doc_id", "index", "value", "y").write.parquet(at)

    def train(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _trained(at)
        yield pa.record_batch([pa.array([None if got.weights is None else got.weights.tobytes()], pa.binary()), pa.array([got.slope]), pa.array([got.offset])], names=["weights", "slope", "offset"])

    got = spark.range(0, 1, 1, 1).mapInArrow(train, "weights binary, slope double, offset double").first()
    return Classifier(None if got["weights"] is None else np.frombuffer(bytes(got["weights"]), np.float32), got["slope"], got["offset"])


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, classifier: Classifier, least: float = LEAST_PROBABILITY) -> DataFrame:
    """doc_id, the counts, base_failed, kept, probability; one row for each row.

    A null or empty text has no words and fails the rules.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SCORED_BYTES):
            texts = text_of(part.column("text"))
            w = Words.of(texts)
            counts = rule_counts(texts, w)
            bad = failed(counts)
            p = model.value.probability(w)
            yield pa.record_batch([part.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in OUT), pa.array(bad), pa.array(~bad & (p >= least)), pa.array(p, pa.float64())], names=["doc_id", *OUT, "base_failed", "kept", "probability"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{k} long' for k in OUT)}, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, classifier: Classifier, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The documents that pass the rules and the classifier, with the columns of `docs`."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SCORED_BYTES):
            texts = text_of(part.column("text"))
            w = Words.of(texts)
            good = ~failed(rule_counts(texts, w)) & (model.value.probability(w) >= least)
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
