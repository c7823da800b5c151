"""Connected components by alternating star steps (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, stored


#: Parts into which a node's neighbours are dealt, so that those of a hub go to several tasks.
SALTS = 8


def _salt(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")


def _salts() -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, path: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (a, b) but the roots.

    A step links each node's neighbours to its smallest neighbour, with minima made
    before the shuffle, and is written to the shared folder; the number of steps grows
    with the logarithm of the components' size.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/0")
    mark, step = _mark(now), 0
    while mark[0]:
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), _salts())
        large = both.select("u", "v", _salt("v")).join(least, ["u", "salt"]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        step += 1
        now = stored(small.filter("a <> b").distinct(), f"{path}/{step}")
        drop_dir(edges.sparkSession, f"{path}/{step - 1}")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.toDF("node", "root")
