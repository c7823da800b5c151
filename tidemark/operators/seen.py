"""First posts of links across runs: a filter of each run's links says which of them to read.

A run's links lie in folders by the first bits of their hash, and beside them a Bloom
filter in blocks of 256 bits: each link sets one bit in each of the four words of the
block that its hash names. Blocks are rows, so the filter is built by `bit_or` in each
task before the shuffle and probed by a join on the block; neither passes the driver.
Links that a filter has are compared with the stored links themselves, of which only the
folders of such hits are read; what no filter has was seen in no run. The result is that
of the anti-join with all links of all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dflt
from ..sources.storage import list_prefixes, stored

#: Links for each block of 256 bits, about 12 bits a link, and folders of a run's links.
BLOCK_LINKS, FOLDERS = 21, 64
WORDS = 4
LINKS = "link string, hash long, run string, folder int"
FILTER = f"block long, {', '.join(f'w{i} long' for i in range(WORDS))}, blocks long, run string"


def masks(link: Column) -> list[Column]:
    """For each word of the block a long with one bit, by a hash that the block's number has no part in."""
    bits = F.xxhash64(F.lit(1), link)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


class SeenLinks:
    """The links of earlier runs below `root`, a stage's folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, posts: DataFrame, run: str) -> None:
        """Store the distinct links of a run and their filter; null is ''. A run that is there is replaced."""
        link = posts.select(dflt("link", "").alias("link")).distinct()
        path = f"{self.root}/links/run={run}"
        hashed = link.withColumn("hash", F.xxhash64("link")).withColumn("folder", F.pmod("hash", F.lit(FOLDERS)).cast("int"))
        hashed.repartition("folder").sortWithinPartitions("folder", "hash").write.mode("overwrite").partitionBy("folder").parquet(path)
        own = self.spark.read.schema("link string, hash long, folder int").parquet(path)
        blocks = max(1, -(-own.count() // BLOCK_LINKS))
        block = F.pmod(F.shiftright("hash", 8), F.lit(blocks)).alias("block")
        words = own.select(block, *(m.alias(f"w{i}") for i, m in enumerate(masks(F.col("link")))))
        made = words.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
        made.withColumn("blocks", F.lit(blocks).cast("long")).write.mode("overwrite").parquet(f"{self.root}/filters/run={run}")

    def runs(self) -> list[str]:
        """The runs whose filter was written, which is written last."""
        return [r.partition("=")[2] for r in list_prefixes(self.spark, self.root, "filters")]

    def maybe(self, links: DataFrame) -> DataFrame:
        """link, run, folder: the links that the filter of a run has, a few of them by chance."""
        if not self.runs():
            return self.spark.createDataFrame([], "link string, run string, folder int")
        filters = self.spark.read.schema(FILTER).parquet(f"{self.root}/filters")
        sizes = filters.select("run", "blocks").distinct()  # one row for each run
        each = links.select("link", F.xxhash64("link").alias("hash")).join(F.broadcast(sizes))
        each = each.withColumn("block", F.pmod(F.shiftright("hash", 8), "blocks"))
        has = F.lit(True)
        for i, m in enumerate(masks(F.col("link"))):
            has = has & (F.col(f"w{i}").bitwiseAND(m) != 0)
        return each.join(filters.drop("blocks"), ["run", "block"]).filter(has).select("link", "run", F.pmod("hash", F.lit(FOLDERS)).cast("int").alias("folder"))

    def stored_links(self, hits: DataFrame) -> DataFrame:
        """The links of the folders that the hits name; Spark prunes the others by their paths."""
        touched = {(r.run, f"folder={r.folder}") for r in hits.select("run", "folder").distinct().collect()}  # at most runs x FOLDERS
        there = {(run, name) for run in {r for r, _ in touched} for name in list_prefixes(self.spark, self.root, f"links/run={run}")}
        paths = [f"{self.root}/links/run={run}/{name}" for run, name in sorted(touched & there)]  # a hit by chance may name a folder that no link is in
        return self.spark.read.schema("link string, hash long").parquet(*paths).select("link") if paths else self.spark.createDataFrame([], "link string")

    def unseen(self, posts: DataFrame) -> DataFrame:
        """The posts whose link is in no run; copies among them stay, as `preprocess` ends those."""
        links = posts.select(dflt("link", "").alias("link")).distinct()
        hits = stored(self.maybe(links), "maybe")
        seen = hits.select("link").distinct().join(self.stored_links(hits).distinct(), "link", "left_semi").withColumnRenamed("link", "_seen")
        return posts.join(seen, dflt("link", "") == F.col("_seen"), "left_anti")
