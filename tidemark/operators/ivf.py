"""Inverted-file vector index: records by coarse centre, searched list by list.

Records lie in a folder for each centre with their angle to it. A search first looks into
the lists nearest to each query. By the triangle inequality no record of a list can be
nearer to a query than the query's angle to the list's centre, less the list's radius; so
the exact search then looks only into lists whose bound is below the angle of the k-th
record found, and ends. An approximate search stops after the first step.

A list that many records share is written in several files, and tasks read parts of
lists. The driver holds the centres (`LISTS` at most) and a block of queries at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.storage import stored
from . import kmeans

#: Lists at most, records of the sample for each list, steps of its k-means, records of a file, lists of the first step.
LISTS, SAMPLE_A_LIST, STEPS, FILE_ROWS, PROBES = 4096, 64, 8, 500_000, 4
#: Queries of a block.
QUERY_BLOCK = 4096
#: Angles are trusted to this much.
SLACK = 1e-6


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, which rows were not zero)."""
    norm = np.linalg.norm(v, axis=1)
    return v / np.maximum(norm, 1e-300)[:, None], norm > 0


@dataclass
class Index:
    spark: SparkSession
    root: str
    centres: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/lists")


def build(vectors: DataFrame, root: str, lists: int | None = None, dim: int | None = None) -> Index:
    """Index records (id, values) below `root`, by about the square root of their number of lists; zero and null vectors are left out.

    Centres are fitted to a sample, `SAMPLE_A_LIST` records for each list with the
    smallest hashes of their ids; every record is indexed. All must have one dimension,
    which is `dim` where it is given.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("values IS NOT NULL").filter(F.exists("values", lambda x: x != 0)).select("id", F.col("values").cast("array<double>").alias("values"))
    n, least, most = rows.agg(F.count("*"), F.min(F.size("values")), F.max(F.size("values"))).first()
    if n and not least == most == (dim or most):
        raise ValueError(f"the index has dimension {dim or least}, records have {least} to {most}")
    lists = max(1, min(lists or round(n**0.5), LISTS, n))
    length = F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_A_LIST * lists).select(F.transform("values", lambda x: x / length).alias("embedding"))
    fitted = kmeans.fit(stored(sample, "ivf"), [lists], 1, steps=STEPS)
    centres = unit(fitted[lists])[0] if fitted else np.zeros((0, dim or 0))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = unit(kmeans.matrix(batch.column("values")))[0] @ shared.value.T
                own = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(own)), own], -1, 1))
                yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)], names=["id", "values", "list", "angle"])

    placed = stored(rows.mapInArrow(place, f"id {vectors.schema['id'].dataType.simpleString()}, values array<double>, list int, angle double"), "ivf")
    counts = placed.groupBy("list").agg(F.count("*").alias("n"), F.min("angle").alias("nearest"), F.max("angle").alias("farthest"))
    bounds = {r["list"]: r for r in counts.collect()}  # LISTS at most
    files = F.broadcast(counts.select("list", F.ceil(F.col("n") / FILE_ROWS).cast("int").alias("files")))
    dealt = placed.join(files, "list").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    dealt.repartition("list", "file").drop("files", "file").write.partitionBy("list").parquet(f"{root}/lists")
    row = [(i, c.tolist(), bounds[i]["nearest"] if i in bounds else 0.0, bounds[i]["farthest"] if i in bounds else -1.0) for i, c in enumerate(centres)]
    spark.createDataFrame(row, "list int, centre array<double>, nearest double, farthest double").coalesce(1).write.parquet(f"{root}/centres")
    return opened(spark, root)


def opened(spark: SparkSession, root: str) -> Index:
    """The index below `root`."""
    rows = spark.read.parquet(f"{root}/centres").orderBy("list").collect()
    return Index(spark, root, np.array([r["centre"] for r in rows], np.float64) if rows else np.zeros((0, 0)), np.array([r["nearest"] for r in rows]), np.array([r["farthest"] for r in rows]))


def search(index: Index, queries: DataFrame, k: int = 10, exact: bool = True, probes: int = PROBES, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k records nearest to each query (query_id, query) by cosine; ties go to the smaller id.

    Exact, or of the `probes` nearest lists only. Queries without a direction (null,
    zero) have no neighbours; a query of another dimension raises.
    """
    spark = index.spark
    key = queries.schema["query_id"].dataType
    schema = f"query_id {key.simpleString()}, id string, score double"
    if not len(index.centres):
        return spark.createDataFrame([], f"{schema}, rank int")
    parts, found = max(1, -(-queries.count() // block)), None
    for i in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).select("query_id", "query").filter("query IS NOT NULL").collect()
        if any(len(r["query"]) != index.dim for r in rows):
            raise ValueError(f"queries must have dimension {index.dim}")
        asked, some = unit(np.array([r["query"] for r in rows], np.float64).reshape(len(rows), index.dim))
        ids = [r["query_id"] for r, x in zip(rows, some, strict=True) if x]
        if ids:
            near = _searched(index, ids, asked[some], key, schema, k, exact, probes)
            found = near if found is None else found.union(near)
    return found if found is not None else spark.createDataFrame([], f"{schema}, rank int")


def _searched(index: Index, ids: list, asked: np.ndarray, key, schema: str, k: int, exact: bool, probes: int) -> DataFrame:
    angle = np.arccos(np.clip(asked @ index.centres.T, -1, 1))
    angle[:, index.farthest < 0] = np.inf  # lists without records
    first = np.zeros(angle.shape, bool)
    np.put_along_axis(first, np.argsort(angle, 1, kind="stable")[:, :probes], True, 1)
    first &= np.isfinite(angle)
    best = _ranked(_in_lists(index, ids, asked, key, schema, k, first), k)
    if not exact:
        return best
    best = stored(best, "ivf-first")
    last = {r["query_id"]: r["least"] for r in best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k).collect()}
    reach = np.array([np.arccos(np.clip(last[i], -1, 1)) if i in last else np.inf for i in ids])
    bound = np.maximum(np.maximum(angle - index.farthest, index.nearest - angle), 0)
    rest = ~first & np.isfinite(angle) & (bound <= reach[:, None] + SLACK)
    if not rest.any():
        return best
    return _ranked(best.drop("rank").union(_in_lists(index, ids, asked, key, schema, k, rest)), k)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _in_lists(index: Index, ids: list, asked: np.ndarray, key, schema: str, k: int, wanted: np.ndarray) -> DataFrame:
    """The best k (and ties with the last) of each task's records for each query, from the lists that the query wants."""
    lists = np.flatnonzero(wanted.any(0))
    shared = index.spark.sparkContext.broadcast((ids, asked, {int(x): np.flatnonzero(wanted[:, x]) for x in lists}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, who = shared.value
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own, v = batch.column("list").to_numpy(), unit(kmeans.matrix(batch.column("values")))[0]
            names = np.array(batch.column("id").cast(pa.string()).to_pylist(), object)
            for x in np.unique(own).tolist():
                at = own == x
                score = np.round(v[at] @ asked[who[x]].T, 12)
                for q, s in zip(who[x].tolist(), score.T, strict=True):
                    least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                    kept = sorted(best.get(q, []) + [(-a, n) for a, n in zip(s[s >= least].tolist(), names[at][s >= least].tolist(), strict=True)])
                    best[q] = kept[:k]
        rows = [(ids[q], n, -a) for q, each in best.items() for a, n in each]
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((to_arrow_type(key), pa.string(), pa.float64()))], names=["query_id", "id", "score"])

    return index.records().filter(F.col("list").isin([int(x) for x in lists])).select("id", "values", "list").mapInArrow(run, schema)
