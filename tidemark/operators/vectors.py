"""Vector records, upsert and cosine search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.rules import is_nonzero
from ..functions.text import dflt, head
from ..sources.bucketed import Table
from ..sources.storage import stored

#: Queries that are sent to all tasks at once.
QUERY_BLOCK = 4096
#: Records and queries that a task multiplies at a time, and pairs that are scored again at a time.
TILE_ROWS, TILE_QUERIES, PIECE = 1024, 1024, 1 << 14
#: More than products of one pair differ by, in whatever order they are added.
SLACK = 1e-9


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def records(df: DataFrame) -> DataFrame:
    """Rows with `embedding` as vector records; zero vectors are left out."""
    meta = F.struct(head("title", 200).alias("title"), head("desc", 500).alias("desc"), dflt("kw", "").alias("kw"), dflt("cafe", "").alias("cafe"), dflt("cluster", -1).cast("int").alias("cluster"))
    return df.filter(is_nonzero("embedding")).select(F.concat(F.lit("doc_"), F.col("pos")).alias("id"), F.col("embedding").alias("values"), meta.alias("metadata"))


def create_index(spark: SparkSession, root: str, schema: StructType, dim: int) -> Table:
    """The table of a vector index, made if there is none; one with another dimension raises."""
    return Table.create(spark, root, schema, dim=dim, metric="cosine")


def upsert_vectors(spark: SparkSession, root: str, df: DataFrame, dim: int | None = None) -> DataFrame:
    """Put the rows' records into the index below `root`, each in place of the one with its id; all records of the new version.

    Only the buckets that the ids fall into are written. The first rows set the
    dimension, unless `dim` does; other ones raise.
    """
    made = stored(records(df), "records")
    least, most = made.agg(F.min(F.size("values")), F.max(F.size("values"))).first()
    there = Table(spark, root).manifest()
    dim = dim or (there.properties["dim"] if there else most)
    if least is not None and not least == most == dim:
        raise ValueError(f"the index has dimension {dim}, records have {least} to {most}")
    table = create_index(spark, root, made.schema, dim or 0)
    table.upsert(made)
    return table.read()


def indexed(spark: SparkSession, root: str) -> DataFrame | None:
    """The records of an index, None where there is none."""
    table = Table(spark, root)
    return table.read() if table.manifest() else None


def search(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k records nearest to a query by cosine: score, id and the metadata's fields."""
    score = cosine(F.col("values"), F.array(*(F.lit(float(x)) for x in query)))
    meta = [f"metadata.{f}" for f in vectors.schema["metadata"].dataType.fieldNames()] if "metadata" in vectors.columns else []
    return vectors.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k).select("score", "id", *meta)


def search_per_group(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest records to each query (query_id, query): query_id, id, score, rank.

    Queries go in blocks of about `block`, so what is sent to all tasks is bounded. Each
    task multiplies its records with a block's queries and keeps k for each before the
    shuffle. Zero vectors have no neighbours. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    parts = max(1, -(-queries.count() // block))
    key = queries.schema["query_id"].dataType.simpleString()
    found = None
    for i in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).select("query_id", "query").collect()
        if not rows:
            continue
        asked = np.array([r["query"] for r in rows], np.float64)
        norms = np.linalg.norm(asked, axis=1)
        shared = spark.sparkContext.broadcast(([r["query_id"] for r, n in zip(rows, norms) if n > 0], asked[norms > 0] / norms[norms > 0, None]))
        near = vectors.select("id", "values").mapInArrow(_nearest(shared, k, to_arrow_type(queries.schema["query_id"].dataType)), f"query_id {key}, id string, score double")
        found = near if found is None else found.union(near)
    if found is None:
        return spark.createDataFrame([], f"query_id {key}, id string, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _nearest(shared, k: int, key: pa.DataType):
    """The best k of a task's records for each query, of equal ones those with the smaller ids.

    Records and queries are multiplied in tiles. Scores that may be among the best are taken
    again row by row, so that equal vectors have equal scores wherever they lie.
    """

    def run(batches):
        ids, asked = shared.value
        best: list[list[tuple]] = [[] for _ in ids]
        least = np.full(len(ids), -np.inf)
        for whole in batches:
            for batch in (whole.slice(at, TILE_ROWS) for at in range(0, whole.num_rows if ids else 0, TILE_ROWS)):
                v = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(v, axis=1)
                names, v = np.array(batch.column("id").to_pylist(), object)[norm > 0], v[norm > 0] / norm[norm > 0, None]
                place = np.empty(len(names), np.int64)
                place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                for base in range(0, len(ids), TILE_QUERIES):
                    own = asked[base : base + TILE_QUERIES]
                    score, limit = v @ own.T, least[base : base + len(own)]
                    if len(v) > k:
                        limit = np.maximum(limit, np.partition(score, -k, axis=0)[-k])
                    row, q = np.nonzero(score >= limit - SLACK)
                    exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", v[row[i : i + PIECE]], own[q[i : i + PIECE]]) for i in range(0, len(row), PIECE))])
                    order = np.lexsort((place[row], -exact, q))
                    row, q, exact = row[order], q[order], exact[order]
                    starts = np.searchsorted(q, np.arange(len(own) + 1))
                    for j in np.flatnonzero(np.diff(starts)).tolist():
                        at = slice(starts[j], min(starts[j] + k, starts[j + 1]))
                        kept = best[base + j] = sorted(best[base + j] + list(zip((-exact[at]).tolist(), names[row[at]].tolist())))[:k]
                        if len(kept) == k:
                            least[base + j] = -kept[-1][0]
        rows = [(i, n, -x) for i, each in zip(ids, best) for x, n in each]
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((key, pa.string(), pa.float64()))], names=["query_id", "id", "score"])

    return run
