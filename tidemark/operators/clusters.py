"""Clusters of posts: summaries, refinement, TF-IDF terms, k-means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dflt, head
from . import kmeans
from .vocabulary import TOKEN, tfidf


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("size"))


def counters(df: DataFrame) -> DataFrame:
    """num_clusters, total_docs."""
    return df.agg(F.countDistinct("cluster").alias("num_clusters"), F.count("*").alias("total_docs"))


def diversity(df: DataFrame) -> DataFrame:
    """Distinct non-empty keywords of each cluster."""
    return df.groupBy("cluster").agg(F.countDistinct(F.when(F.col("kw") != "", F.col("kw"))).alias("n_keywords"))


def top_keywords(df: DataFrame, n: int = 8) -> DataFrame:
    """cluster, kw, count, rank: most frequent first, then first seen."""
    counted = df.filter(F.col("kw") != "").groupBy("cluster", "kw").agg(F.count("*").alias("count"), F.min("pos").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("count"), "_first"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= n).drop("_first")


def samples(df: DataFrame, n: int = 3) -> DataFrame:
    """The first n posts of each cluster, cut in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("pos"))
    cut = {"title": head("title", 80), "desc": head("desc", 150), "cafe": dflt("cafe", ""), "kw": dflt("kw", "")}
    return df.select("cluster", "pos", *(v.alias(k) for k, v in cut.items())).withColumn("rank", rank).filter(F.col("rank") <= n)


def cluster_info(df: DataFrame, top_kw: int = 8, n_samples: int = 3) -> DataFrame:
    """One row for each cluster: size, keywords, keyword_counts, samples."""
    words = top_keywords(df, top_kw).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "kw", "count"))).alias("k"))
    words = words.select("cluster", F.col("k.kw").alias("keywords"), F.map_from_entries(F.transform("k", lambda x: F.struct(x["kw"], x["count"]))).alias("keyword_counts"))
    shown = samples(df, n_samples).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "desc", "cafe", "kw"))).alias("s"))
    shown = shown.select("cluster", F.transform("s", lambda x: F.struct(x["title"], x["desc"], x["cafe"], x["kw"])).alias("samples"))
    return sizes(df).join(words, "cluster", "left").join(shown, "cluster", "left").orderBy("cluster")


def summary_text(df: DataFrame, lines: int = 20, desc_len: int = 100) -> DataFrame:
    """cluster, summary: one line '- title | desc' for each of the first posts."""
    first = F.row_number().over(Window.partitionBy("cluster").orderBy("pos"))
    rows = df.select("cluster", "pos", F.concat(F.lit("- "), dflt("title", ""), F.lit(" | "), head("desc", desc_len)).alias("line")).withColumn("rank", first).filter(F.col("rank") <= lines)
    return rows.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def refine(df: DataFrame, keep: list[int] = (), merge: list[int] = ()) -> DataFrame:
    """Keep the listed clusters (all, without a list), merge the listed ones into the first, number anew from 0."""
    if keep:
        df = df.filter(F.col("cluster").isin(list(keep)))
    if len(merge) > 1:
        df = df.withColumn("cluster", F.when(F.col("cluster").isin(list(merge)), F.lit(merge[0])).otherwise(F.col("cluster")))
    ids = df.select("cluster").distinct()
    ids = ids.select("cluster", (F.dense_rank().over(Window.orderBy("cluster")) - 1).cast("int").alias("_new"))
    return df.join(F.broadcast(ids), "cluster").withColumn("cluster", F.col("_new")).drop("_new")


def terms(df: DataFrame, text: Column, bigrams: bool = True) -> DataFrame:
    """pos, term, tf: lower-cased words of two and more letters, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)
    rows = df.select("pos", words.alias("w"))
    if bigrams:
        near = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        rows = rows.select("pos", F.concat("w", near).alias("w"))
    return rows.select("pos", F.explode("w").alias("term")).groupBy("pos", "term").agg(F.count("*").alias("tf"))


def top_terms(weights: DataFrame, clusters: DataFrame, n: int = 10) -> DataFrame:
    """cluster, term, weight, rank: the terms with the largest mean weight in each cluster."""
    of = clusters.select("pos", "cluster")
    means = weights.join(of, "pos").groupBy("cluster", "term").agg(F.sum("w").alias("s")).join(sizes(of), "cluster")
    means = means.select("cluster", "term", F.round(F.col("s") / F.col("size"), 5).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term"))
    return means.withColumn("rank", rank).filter(F.col("rank") <= n)


def candidate_ks(n: int) -> range:
    return range(3, min(15, n // 10 + 1))


def choose_k(df: DataFrame, seed: int = 42, default: int = 5, n_init: int = 10) -> int:
    """The k of 3..14 with the best silhouette, the smallest of equals; too few rows give min(default, n)."""
    n = df.count()
    found, _ = kmeans.choose_k(df, list(candidate_ks(n)), n_init, seed)
    return found if found is not None else min(default, n)


def assign(df: DataFrame, k: int, n_init: int = 10, seed: int = 42) -> DataFrame:
    """The rows of `df` (embedding) with `cluster`, by the best of `n_init` starts; null without an embedding."""
    fitted = kmeans.fit(df, [k], n_init, seed)
    return kmeans.assigned(df, fitted[k]) if fitted else df.withColumn("cluster", F.lit(None).cast("int"))


__all__ = ["TOKEN", "assign", "choose_k", "cluster_info", "refine", "samples", "sizes", "summary_text", "terms", "tfidf", "top_terms"]
