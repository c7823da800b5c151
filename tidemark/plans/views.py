"""Views over the given tables in the shape of posts, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERSONA_ROWS = [
    (1, "Beginners", [("Ann", "starts out", "too many choices", "wants a guide"), ("Bo", "moves house", "no time", "wants a set")]),
    (3, "Experts", [("Cy", "owns three", "spare parts", "wants a shop")]),
    (9, "Nobody", []),
]
PERSONA_DDL = "cluster_id int, cluster_name string, personas array<struct<name:string,situation:string,pain_point:string,insight:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts: the title is the first 80 characters, the rest is the description."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")), "yyyyMMdd")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), F.col("lang").alias("kw"), F.substring("text", 1, 80).alias("title"), F.expr("substring(text, 81)").alias("desc"), F.md5("text").alias("link"), F.col("source").alias("cafe"), day.alias("date")
    )


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cluster(posts(spark, sf_dir))


def with_cluster(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cluster", (F.col("pos") % 7).cast("int"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select(F.col("page_id").alias("pos"), F.col("url").alias("link"), F.regexp_extract("url", "://([^/]+)", 1).alias("cafename"), title.alias("title"), F.col("html").alias("description"), F.lit("").alias("postdate"))


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", F.col("label").alias("cluster"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_type").alias("job_type"), "ts", "event_id", F.col("value").alias("progress"))


def personas(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame(PERSONA_ROWS, PERSONA_DDL)


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.when(F.col("quality") == 1, '"relevant"').otherwise('"irrelevant"').alias("label"))
    return posts(spark, sf_dir).join(good, "pos")


SQL = {
    "posts": """SELECT doc_id AS pos, lang AS kw, substr(text, 1, 80) AS title, substr(text, 81) AS "desc", md5(text) AS link, source AS cafe,
        strftime(DATE '2024-01-01' + (doc_id % 366)::INT, '%Y%m%d') AS date FROM documents""",
    "clustered": "SELECT *, (pos % 7)::INT AS cluster FROM posts",
    "raw_pages": r"""SELECT page_id AS pos, url AS link, regexp_extract(url, '://([^/]+)', 1) AS cafename,
        regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, html AS description FROM pages""",
    "vecs": "SELECT vec_id AS pos, embedding, label AS cluster FROM embeddings",
    "job_events": "SELECT user_id AS sid, event_type AS job_type, ts, event_id, value AS progress FROM events",
    "personas": """SELECT * FROM (VALUES
        (1, 'Beginners', [{'name': 'Ann', 'situation': 'starts out', 'pain_point': 'too many choices', 'insight': 'wants a guide'}, {'name': 'Bo', 'situation': 'moves house', 'pain_point': 'no time', 'insight': 'wants a set'}]),
        (3, 'Experts', [{'name': 'Cy', 'situation': 'owns three', 'pain_point': 'spare parts', 'insight': 'wants a shop'}]),
        (9, 'Nobody', [])) AS p(cluster_id, cluster_name, personas)""",
}
NEEDS = {"clustered": ["posts"]}


def sql(body: str, *views: str) -> str:
    """A query body that starts with SELECT or further CTEs (", name AS ..."), after the views it needs."""
    names = list(dict.fromkeys(n for v in views for n in [*NEEDS.get(v, []), v]))
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + body
