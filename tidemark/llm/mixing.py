"""Mixing sources to target weights by repetition rates.

Token counts per source give each source's target, the target gives a repetition rate,
and a document is taken floor(rate) times plus once more with the probability of the
remaining fraction, decided by a hash of a seed and its id, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, word_count

#: Source tables of at most this many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, weight, target from rows of (source, size).

    Sources in code-point order, null last, take the weights in turn. They share
    `share` times all sizes by weight, none above `cap` times its own size; the excess
    is shared anew. With sources sorted by size / weight those at the cap come first,
    so running sums find where the cap ends, without iteration.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_turn) - 1) % len(weights) + 1).cast("int")).cast("double")
    table = by_source.withColumn("weight", weight).withColumn("s", F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("s") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest_w = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rest_t = F.lit(share) * F.sum("s").over(everything) - F.lit(cap) * F.coalesce(F.sum("s").over(before), F.lit(0.0))
    table = table.withColumn("at_cap", F.lit(cap) * F.col("s") * rest_w <= rest_t * F.col("weight"))
    free = lambda c: F.sum(F.when(~F.col("at_cap"), F.col(c)).otherwise(0.0)).over(everything)
    left = F.lit(share) * F.sum("s").over(everything) - F.lit(cap) * F.sum(F.when(F.col("at_cap"), F.col("s")).otherwise(0.0)).over(everything)
    return table.select("source", "source_size", "weight", F.when(F.col("at_cap"), F.lit(cap) * F.col("s")).otherwise(F.col("weight") * left / free("weight")).alias("target"))


def hashed_unit(key: F.Column, seed: str) -> F.Column:
    """A number in [0, 1) from the first 52 bits of a hash of the seed and the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _planned(docs: DataFrame, weights: Sequence[int], share: float, cap: float, seed: str) -> DataFrame:
    """row (the whole row of `docs`), size, source_size, target, copies."""
    sized = docs.select(F.struct("*").alias("row"), "doc_id", F.col("source").alias("of"), word_count("text").alias("size"))
    sizes = docs.select("source", word_count("text").alias("size"))
    table = stored(source_targets(sizes, weights, share, cap), shared_dir(docs.sparkSession, "sources"))
    table = table.select("source", "source_size", "target")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(hashed_unit(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return sized.join(table, sized["of"].eqNullSafe(table["source"])).select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """The rows of `docs` with size, source_size, target and copies.

    Null text has size 0; null is a source of its own; rows with one doc_id have one
    draw, those with a null one too; an empty table gives no rows. Columns of `docs` with
    these names are replaced.
    """
    plan = _planned(docs, weights, share, cap, seed)
    own = [f"row.`{c}`" for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    return plan.select(*own, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """Every document as many times as the mix takes it; its columns, whatever their names, stay as they are."""
    plan = _planned(docs, weights, share, cap, seed).filter("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE AS s,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_w,
         1.5::DOUBLE * sum(s) OVER () - 2.0::DOUBLE * coalesce(sum(s) OVER before, 0) AS rest_t
  FROM s WINDOW before AS (ORDER BY s / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a AS (
  SELECT *, 2.0::DOUBLE * s * rest_w <= rest_t * weight AS at_cap FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN at_cap THEN 2.0::DOUBLE * s
              ELSE weight * (1.5::DOUBLE * sum(s) OVER () - 2.0::DOUBLE * sum(CASE WHEN at_cap THEN s ELSE 0 END) OVER ())
                   / sum(CASE WHEN at_cap THEN 0 ELSE weight END) OVER () END AS target
  FROM a
), p AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {2**52}::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken FROM p
"""
