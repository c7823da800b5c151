"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

A text's features are hashed n-grams of one to three tokens, in two readings: the words
as they stand with A-Z in lower case, and their shapes, which keep case, punctuation and
symbols but not the letters, with a mark where a word repeats one of the two before it.
So what a text is made of counts beside what it says. Each n-gram's value is its share of
the text's n-grams, scaled by the square root of their number of kinds, which keeps the
value of long and short texts alike.

Training is the per-coordinate update of follow-the-regularised-leader with L1 and L2
terms: one task streams the bounded sample of labelled rows from a shared file, some
epochs long, and holds one batch and two arrays. Scoring is a sparse dot product of each
text with the weights in Arrow batches; a last two-parameter fit on rows kept back from
training calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, coded, doc_of, hashes, mixed, open_fs, shared_dir, slices, text_of, words_of

#: Hashed features.
DIM = 1 << 20
#: Labelled rows that are learned from: those with the smallest hashes of their ids. One in `KEPT_BACK` calibrates.
FIT_ROWS, KEPT_BACK = 20_000, 5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1.0
#: Text bytes handled at a time, and rows that training reads at a time.
PART_BYTES, PART_ROWS = 2 << 20, 128
ORDERS = (1, 2, 3)


def shapes(words: pa.Array) -> pa.Array:
    """Words with each run of lower-case letters as x, of capitals as X, and of digits as 9."""
    out = pc.replace_substring_regex(words, r"\p{Lu}+", "X")
    out = pc.replace_substring_regex(out, r"[\p{Ll}\p{Lo}\p{Lm}]+", "x")
    return pc.replace_substring_regex(out, r"\p{N}+", "9")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, feature numbers, values): the n-grams of text i are those from offsets[i] to offsets[i + 1]."""
    offsets, words = words_of(texts)
    codes, distinct = coded(words)
    doc, n_texts = doc_of(offsets), len(offsets) - 1
    place = np.arange(len(codes)) - offsets[doc]
    lower = hashes(pc.ascii_lower(distinct))[codes]
    shape = hashes(shapes(distinct))[codes]
    again = np.zeros(len(codes), np.uint64)
    for k in (1, 2):
        same = np.flatnonzero((codes[k:] == codes[:-k]) & (place[k:] >= k)) + k
        again[same] |= np.uint64(k)
    keys, owner = [], []
    with np.errstate(over="ignore"):
        for reading, h in enumerate((lower, mixed(shape * MIX_A + again))):
            gram = np.full(len(h), 1 + reading, np.uint64)
            for n in ORDERS:
                gram = mixed(gram[: max(0, len(h) - n + 1)] * MIX_A + h[n - 1 :]) if len(h) >= n else gram[:0]
                inside = np.flatnonzero(place[n - 1 :] >= n - 1) if len(h) >= n else np.zeros(0, np.int64)
                keys.append((gram[inside] % np.uint64(DIM)).astype(np.int64))
                owner.append(doc[n - 1 :][inside] if len(h) >= n else inside)
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    whole, times = np.unique(owner * DIM + keys, return_counts=True)
    owner, index = whole // DIM, whole % DIM
    kinds = np.bincount(owner, minlength=n_texts)
    total = np.bincount(owner, times, n_texts)
    value = times * (np.sqrt(kinds) / np.maximum(1, total))[owner]
    return np.concatenate([[0], np.cumsum(kinds)]), index, value.astype(np.float32)


@dataclass
class Model:
    """Weights, and the calibration's slope and offset; `weights` is None where one class has no rows."""

    weights: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, texts: pa.Array) -> np.ndarray:
        """Of each text; without weights what the offset says."""
        raw = np.zeros(len(texts)) if self.weights is None else dots(self.weights, *features(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))


def dots(weights: np.ndarray, offsets: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Dot products of the rows with the weights, each summed in the row's own order."""
    return np.bincount(doc_of(offsets), weights[index].astype(np.float64) * value, len(offsets) - 1)


class Leader:
    """Follow the regularised leader: sums `z` of slopes less what the weights already took, and `n` of their squares."""

    def __init__(self, dim: int = DIM, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(dim), np.zeros(dim)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, y: int) -> None:
        w = self.weights(index)
        slope = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - y) * value
        before = self.n[index]
        after = before + slope * slope
        self.z[index] += slope - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[index] = after


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit to (raw, y), by Newton steps, with a weak pull to slope 1."""
    x, theta, pull = np.stack([raw, np.ones(len(raw))], 1), np.array([1.0, 0.0]), np.diag([0.1, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -2, 2)
    return float(max(theta[0], 0.05)), float(theta[1])


def _trained(path: str, epochs: int) -> tuple[np.ndarray | None, float, float]:
    """Stream the rows of the files below `path`: of five, four train and one calibrates."""
    fs, at = open_fs(path)
    from pyarrow.fs import FileSelector

    files = sorted(f.path for f in fs.get_file_info(FileSelector(at)) if f.path.endswith(".parquet"))

    def rows() -> Iterator[tuple[bool, np.ndarray, np.ndarray, int]]:
        number = 0
        for name in files:
            with fs.open_input_file(name) as file:
                for batch in pq.ParquetFile(file).iter_batches(PART_ROWS, columns=["y", "index", "value"]):
                    for y, index, value in zip(batch.column("y").to_pylist(), batch.column("index"), batch.column("value"), strict=True):
                        number += 1
                        yield number % KEPT_BACK == 0, np.frombuffer(index.as_buffer(), np.int32), np.frombuffer(value.as_buffer(), np.float32), y

    leader, seen = Leader(), [0, 0]
    for epoch in range(epochs):
        for back, index, value, y in rows():
            seen[y] += not epoch
            if not back:
                leader.learn(index, value, y)
    if min(seen) == 0:
        return None, 1.0, float(np.log((seen[1] + 1) / (seen[0] + 1)))
    weights = leader.weights().astype(np.float32)
    held = [(float(weights[index] @ value), y) for back, index, value, y in rows() if back]
    if len({y for _, y in held}) < 2:
        return weights, 1.0, 0.0
    raw, y = np.array(held).T
    return weights, *calibrate(raw, y)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, epochs: int = EPOCHS) -> Model:
    """Fit to at most `rows` rows of labels (doc_id, quality 0 or 1) whose ids `docs` has.

    Labels that are null or of no document are left out, of several for one id the least
    counts, and of repeated rows of one id each distinct text is a row. Without rows of
    both classes every score is the share of good ones, of which an empty table has half.
    """
    spark = docs.sparkSession
    at = shared_dir(spark, "ftrl")
    given = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    known = given.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen.write.parquet(f"{at}/chosen")
    chosen = spark.read.schema("doc_id long, y int").parquet(f"{at}/chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART_BYTES):
            offsets, index, value = features(text_of(part.column("text")))
            cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.record_batch([part.column("h"), part.column("y"), cut(index, np.int32), cut(value, np.float32)], names=["h", "y", "index", "value"])

    own = texts.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", "y")  # `rows` of two numbers
    made = own.mapInArrow(run, "h long, y int, index binary, value binary").repartition(1).sortWithinPartitions("h", "y")
    made.dropDuplicates(["h"]).sortWithinPartitions("h").write.parquet(f"{at}/rows")

    def train(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, offset = _trained(f"{at}/rows", epochs)
        yield pa.record_batch([pa.array([None if weights is None else weights.tobytes()], pa.binary()), pa.array([slope]), pa.array([offset])], names=["weights", "slope", "offset"])

    got = spark.range(0, 1, 1, 1).mapInArrow(train, "weights binary, slope double, offset double").first()
    return Model(None if got["weights"] is None else np.frombuffer(bytes(got["weights"]), np.float32), got["slope"], got["offset"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted; one row for each row, null and empty texts included, which have no n-grams and so the offset's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART_BYTES):
            p = shared.value.probability(text_of(part.column("text")))
            yield pa.record_batch([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
