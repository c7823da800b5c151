"""The pipeline's stages as functions: each reads stage tables, writes the next one, and logs its job's states."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import run_ts
from ..functions.text import post_text
from ..operators import classify, clusters, personas, posts, vectors
from ..schemas import CLASSIFIED, CLUSTERED, JOB_EVENT, PREPROCESSED
from ..sources import calls, storage
from ..sources.providers import SearchSource, completer_of, complete, embed, embedder_of
from ..sources.storage import Settings

POSTS = f"{PREPROCESSED}, pos bigint"
JOBS = "jobs"


def log(spark: SparkSession, root: str, sid: str, job: str, status: str, progress: float, error: str | None = None) -> None:
    """Append a job's state."""
    row = spark.createDataFrame([(sid, job, datetime.now(), status, progress, error)], JOB_EVENT)
    row.write.mode("append").parquet(f"{root}/{JOBS}")


def job(name: str):
    """A stage whose start, end and failure are logged; the failure is raised on."""

    def wrap(stage):
        def run(spark: SparkSession, settings: Settings, sid: str, **options) -> DataFrame:
            log(spark, settings.root, sid, name, "running", 0.0)
            try:
                out = stage(spark, settings, sid, options.pop("run", None) or run_ts(), **options)
            except Exception as e:
                log(spark, settings.root, sid, name, "error", 0.0, str(e)[:500])
                raise
            log(spark, settings.root, sid, name, "done", 100.0)
            return out

        run.__doc__ = stage.__doc__
        return run

    return wrap


def read(spark: SparkSession, settings: Settings, stage: str, sid: str, schema: str, snapshot: str = "all") -> DataFrame:
    return storage.read_stage(spark, settings.root, stage, sid, schema, snapshot).drop("sid", "run_ts")


@job("crawl")
def collect(spark, settings, sid, run, brand: str, keywords: list[str], target: int = 50_000, wave: int = 8, **filters) -> DataFrame:
    """Search rows of all keywords as posts, filtered, the first `target` in order; stage `raw`.

    Keywords are asked in waves; the target ends the crawl before the next one, and a
    date bound ends a keyword at the first page before it.
    """
    posts.given(brand, "brand")
    posts.given(keywords, "keywords")
    spark.dataSource.register(SearchSource)
    since, made = (filters.get("date_from") or "").replace("-", ""), None
    place = (F.col("kw_pos") * 100_000_000 + F.col("page") * 100_000 + F.col("item_pos")).cast("long")
    for first in range(0, len(keywords), wave):
        source = spark.read.format("search").option("brand", brand).option("keywords", json.dumps(keywords[first : first + wave])).option("provider", settings.search).option("headers", settings.search_headers).option("since", since)
        found = posts.from_search(source.load().withColumn("kw_pos", F.col("kw_pos") + first))
        rows = posts.crawl_filters(found.withColumn("pos", place), brand, **filters).select("kw", "title", "desc", "link", "cafe", "date", "pos")
        made = rows if made is None else made.union(rows)
        made, total = posts.with_total(made)
        if total.first()["total"] >= target:
            break
    storage.write_stage(posts.take_target(made, ["pos"], target), settings.root, "raw", sid, run)
    return posts.cafe_stats(read(spark, settings, "raw", sid, "kw string, title string, `desc` string, link string, cafe string, date string, pos bigint"))


@job("preprocess")
def preprocess(spark, settings, sid, run, ad_terms: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Posts of the session without ads and copies; stage `preprocessed`. Returns the counters."""
    before = posts.not_empty(read(spark, settings, "raw", sid, "kw string, title string, `desc` string, link string, cafe string, date string, pos bigint"), "raw posts")
    storage.write_stage(posts.preprocess(before, ad_terms, exclude), settings.root, "preprocessed", sid, run)
    return posts.counters(before, read(spark, settings, "preprocessed", sid, POSTS, "latest"))


@job("train")
def train_and_score(spark, settings, sid, run, labeled: DataFrame, **models) -> DataFrame:
    """Fit the three models, score the posts, write stages `classified` and `irrelevant`. Returns the counters and accuracies."""
    model = classify.fit_ensemble(labeled, **models)
    scored = model.score(read(spark, settings, "preprocessed", sid, POSTS, "latest"))
    relevant, other = classify.split(scored)
    storage.write_stage(relevant, settings.root, "classified", sid, run)
    storage.write_stage(other, settings.root, "irrelevant", sid, run)
    accuracy = model.cv_scores().groupBy().pivot("model", list(classify.MODELS)).agg(F.first("accuracy"))
    return classify.counters(scored).join(accuracy)


def embedded(spark: SparkSession, settings: Settings, rows: DataFrame) -> DataFrame:
    """The posts with `embedding`; where the settings name a cache, no text is sent twice, over all stages and runs."""
    if not settings.cache:
        return embed(rows, post_text(), embedder_of(settings))
    return calls.embed(rows, post_text(), embedder_of(settings), calls.CallCache(spark, settings.cache), settings.embedder_model)


def answered(spark: SparkSession, settings: Settings, prompts: DataFrame, max_tokens: int) -> DataFrame:
    """The prompts with `answer`, through the cache where the settings name one."""
    if not settings.cache:
        return complete(prompts, completer_of(settings), max_tokens)
    return calls.complete(prompts, completer_of(settings), calls.CallCache(spark, settings.cache), settings.llm_model, max_tokens)


@job("cluster")
def cluster(spark, settings, sid, run, num_clusters: int = 0) -> DataFrame:
    """Embed and group the relevant posts, or all where none were classified; stage `clusters`. Returns each cluster's summary."""
    schema = f"{CLASSIFIED}, pos bigint"
    rows = storage.first_non_empty(read(spark, settings, "classified", sid, schema, "latest"), read(spark, settings, "preprocessed", sid, POSTS, "latest"))
    posts.not_empty(rows, "posts")
    rows = embedded(spark, settings, rows)
    k = num_clusters or clusters.choose_k(rows)
    storage.write_stage(clusters.assign(rows, k).drop("embedding"), settings.root, "clusters", sid, run)
    return clusters.cluster_info(read(spark, settings, "clusters", sid, f"{CLUSTERED}, pos bigint", "latest"))


def clustered(spark: SparkSession, settings: Settings, sid: str) -> DataFrame:
    """The session's refined clusters, else its clusters."""
    schema = f"{CLUSTERED}, pos bigint"
    return storage.first_non_empty(*(read(spark, settings, x, sid, schema, "latest") for x in ("refined", "clusters")))


@job("refine")
def refine(spark, settings, sid, run, keep: list[int] = (), merge: list[int] = ()) -> DataFrame:
    """Keep and merge clusters; stage `refined`. Returns the counters."""
    storage.write_stage(clusters.refine(read(spark, settings, "clusters", sid, f"{CLUSTERED}, pos bigint", "latest"), keep, merge), settings.root, "refined", sid, run)
    return clusters.counters(clustered(spark, settings, sid))


@job("embed")
def build_vectors(spark, settings, sid, run) -> DataFrame:
    """Embed the clustered posts and put them into the session's index."""
    rows = embedded(spark, settings, posts.not_empty(clustered(spark, settings, sid), "clusters"))
    return vectors.upsert_vectors(spark, f"{settings.root}/vectors/{sid}", rows)


@job("persona")
def make_personas(spark, settings, sid, run, bk: str, examples: DataFrame | None = None) -> DataFrame:
    """Ask for personas of all clusters, with search hits where there is an index; stage `personas`. A malformed answer raises."""
    rows = posts.not_empty(clustered(spark, settings, sid), "clusters")
    index = vectors.indexed(spark, f"{settings.root}/vectors/{sid}")
    hits = None if index is None else personas.retrieved(rows, index, embedder_of(settings))
    answers = personas.parse_personas(answered(spark, settings, personas.persona_prompt(rows, bk, examples, hits), 8000))
    if answers.filter("state = 'error'").count():
        raise ValueError("the answer is no JSON array")
    empty = F.array().cast(answers.schema["personas"].dataType)
    made = answers.join(clusters.counters(rows)).select("bk", F.coalesce("personas", empty).alias("personas"), "num_clusters", "total_docs", F.lit(run).alias("timestamp"))
    storage.write_stage(made, settings.root, "personas", sid, run)
    return made
