"""Chunks of texts, and exchanges of key blobs between chunks and key buckets.

A chunk is a few megabytes of whole texts in one file of the shared folder, so that several passes see the same rows in the same order. A pass sends, for
each chunk and key bucket, one blob of the chunk's distinct keys; a bucket's task
compares all blobs and answers each chunk with one blob, in the order sent. So a key
that a third of all rows have is sent once per chunk, no task gathers more than a
bucket, and the shuffle moves packed arrays, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_fs, release, slices, stored, text_of, words_of

CHUNK_BYTES = 8 << 20
#: Tasks over which a list of chunks is dealt at most.
CHUNK_TASKS = 100_000
#: Keys that a bucket is planned for; a task holds them all.
BUCKET_KEYS = 500_000
CHUNK = "chunk string, n_words long"
BLOB = "bucket int, chunk string, keys binary"


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def as_they_are(rows: pa.RecordBatch) -> tuple[int, pa.RecordBatch]:
    return len(words_of(rows.column("text"))[1]), rows


def make_chunks(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id", "text"), size: int = CHUNK_BYTES, form: Callable[[pa.RecordBatch], tuple[int, pa.RecordBatch]] = as_they_are) -> DataFrame:
    """Write the rows of `docs` in chunks of about `size` bytes of text; a longer text is a chunk of its own.

    Each chunk is a file under `path`, which is shared, so passes read it where they need
    it and no shuffle carries it. `form` makes the number of words and the batch that is
    written of a chunk's rows. A task that runs again writes under new names, and only
    the names of finished tasks are listed. The result has a row for each chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        fs, folder = open_fs(path)
        held, n = [], 0

        def made() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            words, batch = form(whole)
            chunk = f"{path}/files/{context.partitionId()}-{number}-{context.taskAttemptId()}"
            with fs.open_output_stream(f"{folder}/files/{chunk.rpartition('/')[2]}") as out:
                out.write(packed(batch))
            return pa.record_batch([pa.array([chunk]), pa.array([words], pa.int64())], names=["chunk", "n_words"])

        for part in slices(batches, "text", size):
            text = text_of(part.column("text"))
            part = pa.RecordBatch.from_arrays([text if f.name == "text" else part.column(f.name) for f in part.schema], names=part.schema.names)
            if held and n + part.nbytes > size * 5 // 4:
                yield made()
                held, n, number = [], 0, number + 1
            held.append(part)
            n += part.nbytes
        if held:
            yield made()

    fs, folder = open_fs(path)
    fs.create_dir(f"{folder}/files", recursive=True)
    return stored(docs.select(*columns).mapInArrow(run, CHUNK), f"{path}/list")


def load(chunk: str) -> pa.RecordBatch:
    fs, at = open_fs(chunk)
    with fs.open_input_stream(at) as file:
        return unpacked(file.read())


def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The chunks that a task has rows of, one after the other."""
    for batch in batches:
        for chunk in batch.column("chunk").to_pylist():
            yield chunk, load(chunk)
            release()


def tasks_of(chunks: DataFrame) -> int:
    return max(1, min(2 * chunks.count(), CHUNK_TASKS))


def dealt(chunks: DataFrame) -> DataFrame:
    """The list of chunks over the tasks, one by one."""
    return chunks.repartition(tasks_of(chunks), "chunk")


def bucket_bits(n_keys: int) -> int:
    return max(4, math.ceil(math.log2(max(1, n_keys) / BUCKET_KEYS)))


def total_words(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]


def low_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits of 64-bit keys that follow the bits of their bucket."""
    return (keys << np.uint64(bits)) >> np.uint64(24)


def buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of 64-bit keys."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def cuts_of(sorted_buckets: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, first place, end) of each bucket that has some."""
    own, first = np.unique(sorted_buckets, return_index=True)
    return list(zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_buckets)][: len(own)], strict=True))


def with_answers(chunks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """run(chunk id, batch of the chunk's rows, its answers) for every chunk."""
    marks = chunks.selectExpr("CAST(NULL AS int) AS bucket", "chunk", "CAST(NULL AS binary) AS keys")

    def each(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        out = run(chunk, load(chunk), table.filter(pc.is_valid(table.column("bucket"))))
        release()
        return out

    rows = answers.select("bucket", "chunk", "keys").union(marks).repartition(tasks_of(chunks), "chunk")  # by the work, not by the bytes of the answers
    return rows.groupBy("chunk").applyInArrow(each, schema)
