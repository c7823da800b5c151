"""Helpers of the training-data operators: word columns, shared folders, chunks.

Words are `[^\\x20\\x09-\\x0D]+`; Arrow's ASCII white space is exactly that
complement, so splitting stays in Arrow's C++ kernels.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles.
SLICE_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_base() -> str:
    """For local sessions without the setting, as in tests."""
    return f"file://{tempfile.mkdtemp(prefix='tidemark-')}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir; a cluster without the setting raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or _own_base()).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Keys with more than this share of all rows are joined by broadcast; there are fewer than its inverse.
HOT_SHARE = 0.001


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with a table that has one row and the number `n` of rows for each key.

    The few keys that many rows have go by broadcast, so no task gathers their rows; the
    others by a shuffle.
    """
    table = stored(table, shared_dir(rows.sparkSession, "counted"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(table.filter(F.col("n") > HOT_SHARE * total))
    cold = rows.join(F.broadcast(table.filter(F.col("n") > HOT_SHARE * total).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(table.filter(F.col("n") <= HOT_SHARE * total), keys))


def drop_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a shared folder and read it again, which cuts the lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store behind a URI; Hadoop's name of S3 is mapped to Arrow's."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def free_name(name: str, taken: list[str]) -> str:
    """The name, or with underscores at its end where columns have it already."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def text_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


@cache
def _trim():
    """The C library's way to give freed memory back, where it has one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give freed memory back to the system, since workers stay for the next task."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where the text in `column` reaches `limit` bytes; no row is cut.

    Freed memory is given back after each batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        release()


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words of text i are words[offsets[i]:offsets[i + 1]]."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    kept = np.concatenate([[0], np.cumsum(full)])
    return kept[offsets - offsets[0]].astype(np.int64), flat.filter(pa.array(full))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct words)."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def doc_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def byte_views(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings without nulls."""
    values = values.cast(pa.string())
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * MIX_B
        x = (x ^ (x >> np.uint64(29))) * MIX_A
        return x ^ (x >> np.uint64(32))


def hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
