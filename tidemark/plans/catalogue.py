"""The query catalogue: one entry for each operator, with the same query in SQL where SQL has it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import classify, clusters, ivf, jobs, keywords, personas, posts, vectors
from ..operators.seen import SeenLinks
from ..sources.providers import BLANK, OfflineEmbedder, SearchSource, complete, embed, score_keywords
from ..sources.bucketed import Table
from ..sources.storage import first_non_empty, latest_run, read_lines, read_stage, scratch, write_lines, write_stage
from . import views
from .views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ADS, EXCLUDE = ["license"], ["src3"]
HAY = "lower(coalesce(title, '') || ' ' || coalesce(\"desc\", ''))"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\v\x{{85}}\p{{Z}}]+|[\s\v\x{{85}}\p{{Z}}]+$', '', 'g')"


def cleaned(x: str) -> str:
    return trimmed(rf"replace(replace(replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


PREPROCESSED = f"""
, kept AS (SELECT * FROM posts WHERE NOT contains({HAY}, 'license') AND NOT contains(lower(cafe), 'src3')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY pos) AS rn FROM kept),
done AS (SELECT *, pos AS idx FROM firsts WHERE rn = 1 AND NOT (length(title) < 5 AND length("desc") < 10))
"""


def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.preprocess(views.posts(spark, sf_dir), ADS, EXCLUDE)


@query(sql(PREPROCESSED + 'SELECT idx, kw, title, "desc", link, cafe, date FROM done', "posts"))
def preprocess_posts(spark, sf_dir):
    return preprocessed(spark, sf_dir).select("idx", "kw", "title", "desc", "link", "cafe", "date")


@query(sql(PREPROCESSED + "SELECT (SELECT count(*) FROM posts) AS original, (SELECT count(*) FROM done) AS filtered", "posts"))
def preprocess_counters(spark, sf_dir):
    return posts.counters(views.posts(spark, sf_dir), preprocessed(spark, sf_dir))


@query(sql(PREPROCESSED + "SELECT cafe, count(*) AS count FROM done GROUP BY cafe", "posts"))
def cafe_stats(spark, sf_dir):
    return posts.cafe_stats(preprocessed(spark, sf_dir))


@query(sql(f" SELECT pos, {cleaned('title')} AS title, cafename AS cafe, md5({cleaned('description')}) AS desc_md5, length({cleaned('description')}) AS desc_length FROM raw_pages", "raw_pages"))
def clean_html(spark, sf_dir):
    made = posts.from_search(views.raw_pages(spark, sf_dir))
    return made.select("pos", "title", "cafe", F.md5("desc").alias("desc_md5"), F.length("desc").cast("long").alias("desc_length"))


CRAWLED = f"""
, crawled AS (SELECT * FROM posts WHERE date BETWEEN '20240201' AND '20241031' AND NOT contains({HAY}, 'license')
  AND NOT contains(lower(cafe), 'src3') AND (contains(lower(cafe), 'src1') OR contains(lower(cafe), 'src2')) AND contains({HAY}, 'the'))
"""


def crawled(spark, sf_dir):
    return posts.crawl_filters(views.posts(spark, sf_dir), "The", ADS, EXCLUDE, ["SRC1", "src2"], "2024-02-01", "2024-10-31")


@query(sql(CRAWLED + "SELECT pos, kw, link, cafe, date FROM crawled", "posts"))
def crawl_filters(spark, sf_dir):
    return crawled(spark, sf_dir).select("pos", "kw", "link", "cafe", "date")


@query(sql(CRAWLED + "SELECT pos, kw, link FROM crawled ORDER BY kw, pos LIMIT 50", "posts"))
def crawl_target_limit(spark, sf_dir):
    return posts.take_target(crawled(spark, sf_dir), ["kw", "pos"], 50).select("pos", "kw", "link")


@query(sql(""", d AS (SELECT pos, CASE pos % 5 WHEN 0 THEN '' WHEN 1 THEN '20240230' ELSE date END AS d FROM posts)
SELECT pos, coalesce(try_strptime(d, '%Y%m%d') IS NULL OR try_strptime(d, '%Y%m%d') BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-03-31', true) AS keep FROM d""", "posts"))
def date_window(spark, sf_dir):
    rows = views.posts(spark, sf_dir).withColumn("date", F.when(F.col("pos") % 5 == 0, "").when(F.col("pos") % 5 == 1, "20240230").otherwise(F.col("date")))
    return rows.select("pos", text.in_date_window("date", "2024-03-01", "2024-03-31").alias("keep"))


@query(sql(f""", t AS (SELECT pos, list_filter(list_transform(string_split(title, ','), lambda x: {trimmed('x')}), lambda x: x <> '') AS terms FROM posts)
SELECT pos, len(terms)::BIGINT AS n_terms, array_to_string(terms, '|') AS terms FROM t""", "posts"))
def csv_terms(spark, sf_dir):
    rows = views.posts(spark, sf_dir).select("pos", text.split_terms("title").alias("t"))
    return rows.select("pos", F.size("t").cast("long").alias("n_terms"), F.array_join("t", "|").alias("terms"))


SCORE = "CASE WHEN {0} IS NULL THEN 50 WHEN {0} >= 10000 THEN 95 WHEN {0} >= 5000 THEN 85 WHEN {0} >= 1000 THEN 75 WHEN {0} >= 500 THEN 65 WHEN {0} >= 100 THEN 55 WHEN {0} >= 50 THEN 45 WHEN {0} >= 10 THEN 35 ELSE 25 END"


@query(f"""WITH t AS (SELECT doc_id AS pos, CASE WHEN doc_id % 11 <> 0 THEN n_chars % (10 ** (doc_id % 5 + 1))::BIGINT END AS total FROM documents),
s AS (SELECT *, {SCORE.format('total')} AS score FROM t)
SELECT pos, total, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS band FROM s""")
def keyword_score(spark, sf_dir):
    total = F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") % F.pow(F.lit(10), F.col("doc_id") % 5 + 1).cast("long"))
    rows = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), total.alias("total"))
    return rows.withColumn("score", rules.score_of_total("total")).withColumn("band", rules.score_band("score"))


WORDS = "w AS (SELECT doc_id AS pos, split_part(text, ' ', 1) AS kw, lang AS cat FROM documents), old AS (SELECT * FROM w WHERE pos % 3 = 0), fresh AS (SELECT * FROM w WHERE pos % 3 <> 0 AND length(kw) >= 2 AND lower(kw) NOT IN (SELECT lower(kw) FROM old))"


def first_words(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.split_part("text", F.lit(" "), F.lit(1)).alias("kw"), F.col("lang").alias("cat"))


def fresh_words(spark, sf_dir):
    w = first_words(spark, sf_dir)
    return keywords.new_keywords(w.filter("pos % 3 <> 0"), w.filter("pos % 3 = 0"))


@query(f"WITH {WORDS} SELECT pos, kw, cat FROM fresh")
def keyword_new_only(spark, sf_dir):
    return fresh_words(spark, sf_dir)


@query(f"WITH {WORDS} SELECT (row_number() OVER (ORDER BY pos))::INT AS id, kw, {SCORE.format('length(kw) * 20')} AS score FROM fresh")
def keyword_ranked(spark, sf_dir):
    scored = fresh_words(spark, sf_dir).withColumn("score", rules.score_of_total(F.length("kw") * 20))
    return keywords.numbered_ranked(scored).select("id", "kw", "score")


@query("""SELECT lang AS cat, count(*) FILTER (doc_id % 2 = 0) AS existing, count(*) FILTER (doc_id % 2 = 1) AS new,
count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 > 0) AS approved, count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 = 0) AS rejected FROM documents GROUP BY lang""")
def keyword_category_rollup(spark, sf_dir):
    rows = first_words(spark, sf_dir).withColumns({"state": F.when(F.col("pos") % 2 == 0, "old").otherwise("new"), "rejected": F.col("pos") % 3 == 0})
    return keywords.category_rollup(rows)


@query("SELECT count(DISTINCT source) >= 10 AS collapse FROM documents")
def keyword_many_categories(spark, sf_dir):
    return keywords.many_categories(views.table(spark, sf_dir, "documents").select(F.col("source").alias("cat")))


@query("""WITH w AS (SELECT doc_id AS pos, split_part(text, ' ', 2) AS kw, lang AS cat FROM documents),
old AS (SELECT lower(kw) AS k, arg_min(cat, pos) AS matched_cat FROM w WHERE pos % 2 = 0 GROUP BY 1),
j AS (SELECT pos, kw AS word, matched_cat, CASE WHEN matched_cat IS NULL THEN 'insert' WHEN matched_cat = 'en' THEN 'reject' ELSE 'move' END AS verdict
      FROM w LEFT JOIN old ON lower(kw) = k WHERE pos % 2 = 1 AND cat = 'en')
SELECT word, verdict, matched_cat FROM j WHERE pos <= coalesce((SELECT min(pos) FROM j WHERE verdict = 'move'), 9223372036854775807)""")
def manual_add_verdict(spark, sf_dir):
    w = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.split_part("text", F.lit(" "), F.lit(2)).alias("kw"), F.col("lang").alias("cat"))
    return keywords.manual_add_verdict(w.filter("pos % 2 = 1 and cat = 'en'").select("pos", F.col("kw").alias("word")), w.filter("pos % 2 = 0"), "en")


@query("WITH k AS (SELECT 1 + doc_id % 3 AS round, doc_id // 3 AS id, lang AS cat FROM documents) SELECT round, id, cat FROM k WHERE NOT (round = 2 AND id % 4 = 0)")
def keyword_review(spark, sf_dir):
    k = views.table(spark, sf_dir, "documents").select((1 + F.col("doc_id") % 3).alias("round"), F.floor(F.col("doc_id") / 3).alias("id"), F.col("lang").alias("cat"))
    return keywords.apply_review(k, k.filter("round = 2 and id % 4 = 0"))


@query("""SELECT doc_id AS pos, CASE WHEN (CASE doc_id % 5 WHEN 0 THEN '"relevant"' WHEN 1 THEN '1' WHEN 2 THEN '"1"' WHEN 3 THEN '0' END) IN ('"relevant"', '1') THEN 1 ELSE 0 END AS y FROM documents""")
def label_normalise(spark, sf_dir):
    label = F.when(F.col("doc_id") % 5 == 0, '"relevant"').when(F.col("doc_id") % 5 == 1, "1").when(F.col("doc_id") % 5 == 2, '"1"').when(F.col("doc_id") % 5 == 3, "0")
    return classify.normalise_labels(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), label.alias("label"))).select("pos", "y")


@query("""WITH s AS (SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS done FROM documents GROUP BY source)
SELECT source, CASE WHEN ceil(total * 0.02::DOUBLE) > 0 THEN least(100, floor(done * 100 / ceil(total * 0.02::DOUBLE) + 0.5)::BIGINT) ELSE 0 END AS pct FROM s""")
def label_progress(spark, sf_dir):
    s = views.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("done"))
    return s.select("source", rules.label_pct("done", "total").alias("pct"))


@query(sql(" SELECT pos, link FROM posts ORDER BY md5(pos::VARCHAR), pos LIMIT (SELECT least(20, greatest(10, count(*) * 2 // 100)) FROM posts)", "posts"))
def label_sample(spark, sf_dir):
    return posts.label_sample(views.posts(spark, sf_dir)).select("pos", "link")


@query(sql(" SELECT pos, ((row_number() OVER (ORDER BY pos) - 1) // 128)::BIGINT AS batch FROM posts", "posts"))
def batch_numbers(spark, sf_dir):
    return posts.with_batch(views.posts(spark, sf_dir), 128).select("pos", F.col("batch").cast("long"))


@query(sql(" SELECT cluster, count(*) AS size FROM clustered GROUP BY cluster", "clustered"))
def cluster_size(spark, sf_dir):
    return clusters.sizes(views.clustered(spark, sf_dir))


@query(sql(" SELECT cluster, count(DISTINCT nullif(kw, '')) AS n_keywords FROM clustered GROUP BY cluster", "clustered"))
def cluster_diversity(spark, sf_dir):
    return clusters.diversity(views.clustered(spark, sf_dir))


TOP = """, c AS (SELECT cluster, cafe AS kw, count(*) AS count, min(pos) AS f FROM clustered WHERE cafe <> '' GROUP BY ALL),
t AS (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY count DESC, f))::INT AS rank FROM c)"""


@query(sql(TOP + " SELECT cluster, kw, count, rank FROM t WHERE rank <= 8", "clustered"))
def cluster_top_kw(spark, sf_dir):
    return clusters.top_keywords(views.clustered(spark, sf_dir).withColumn("kw", F.col("cafe")))


@query(sql(TOP + " SELECT cluster, string_agg(kw || '=' || count, ',' ORDER BY rank) AS counts FROM t WHERE rank <= 8 GROUP BY cluster", "clustered"))
def cluster_kw_map(spark, sf_dir):
    info = clusters.cluster_info(views.clustered(spark, sf_dir).withColumn("kw", F.col("cafe")))
    return info.select("cluster", F.array_join(F.transform("keywords", lambda k: F.concat(k, F.lit("="), F.element_at("keyword_counts", k).cast("string"))), ",").alias("counts"))


@query(sql(""", s AS (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY pos))::INT AS rank FROM clustered)
SELECT cluster, rank, substr(title, 1, 80) AS title, substr("desc", 1, 150) AS "desc", cafe, kw FROM s WHERE rank <= 3""", "clustered"))
def cluster_samples(spark, sf_dir):
    return clusters.samples(views.clustered(spark, sf_dir)).drop("pos")


@query(sql(""", m AS (SELECT pos, CASE WHEN cluster IN (2, 5) THEN 2 ELSE cluster END AS c FROM clustered WHERE cluster IN (0, 2, 5, 6))
SELECT pos, (dense_rank() OVER (ORDER BY c) - 1)::INT AS cluster FROM m""", "clustered"))
def cluster_refine(spark, sf_dir):
    return clusters.refine(views.clustered(spark, sf_dir), [0, 2, 5, 6], [2, 5]).select("pos", "cluster")


SUMMARY = """, s AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) AS rank FROM clustered),
y AS (SELECT cluster, string_agg('- ' || title || ' | ' || substr("desc", 1, 100), chr(10) ORDER BY pos) AS summary FROM s WHERE rank <= 20 GROUP BY cluster)"""


@query(sql(SUMMARY + " SELECT cluster, summary FROM y", "clustered"))
def cluster_summary_text(spark, sf_dir):
    return clusters.summary_text(views.clustered(spark, sf_dir))


@query(sql(SUMMARY + """, z AS (SELECT cluster, count(*) AS n, count(DISTINCT nullif(kw, '')) AS k FROM clustered GROUP BY cluster)
SELECT cluster, chr(10) || '### Cluster ' || (cluster + 1) || ' (' || n || ' posts, ' || k || ' keywords)' || chr(10) || summary || chr(10) AS text FROM y JOIN z USING (cluster)""", "clustered"))
def persona_context(spark, sf_dir):
    return personas.cluster_context(views.clustered(spark, sf_dir))


@query(sql(""", s AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) AS rank FROM clustered),
t AS (SELECT cluster, string_agg(substr(title, 1, 30), ', ' ORDER BY pos) AS titles FROM s WHERE rank <= 3 GROUP BY cluster), z AS (SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster)
SELECT cluster, 'Cluster ' || (cluster + 1) || ' (' || n || ' posts): ' || titles AS line FROM t JOIN z USING (cluster)""", "clustered"))
def chat_clusters(spark, sf_dir):
    return personas.chat_clusters(views.clustered(spark, sf_dir))


TFIDF = """, w AS (SELECT pos, regexp_extract_all(lower(title || ' ' || "desc"), '[\\p{L}\\p{N}_]{2,}') AS w FROM posts),
e AS (SELECT pos, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w),
tf AS (SELECT pos, term, count(*) AS tf FROM e GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM posts) ORDER BY sum(tf) DESC, term LIMIT 3000),
x AS (SELECT pos, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM posts)) / (1.0::DOUBLE + df)) + 1) AS x FROM tf JOIN v USING (term)),
wt AS (SELECT pos, term, x / sqrt(sum(x * x) OVER (PARTITION BY pos)) AS w FROM x)"""


def weights(spark, sf_dir):
    return clusters.tfidf(views.posts(spark, sf_dir), text.post_text(), 3000, 2, 0.95)


@query(sql(TFIDF + " SELECT pos, term, round(w, 5) AS w FROM wt", "posts"))
def tfidf_terms(spark, sf_dir):
    return weights(spark, sf_dir).select("pos", "term", F.round("w", 5).alias("w"))


@query(sql(TFIDF + """, m AS (SELECT (pos % 7)::INT AS cluster, term, sum(w) AS s FROM wt GROUP BY ALL), z AS (SELECT (pos % 7)::INT AS cluster, count(*) AS n FROM posts GROUP BY 1),
r AS (SELECT cluster, term, round(s / n, 5) AS weight FROM m JOIN z USING (cluster)), k AS (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term))::INT AS rank FROM r)
SELECT * FROM k WHERE rank <= 10""", "posts"))
def cluster_tfidf_top10(spark, sf_dir):
    return clusters.top_terms(weights(spark, sf_dir), views.clustered(spark, sf_dir))


def stored_vectors(spark, sf_dir):
    return views.vecs(spark, sf_dir).select(F.concat(F.lit("doc_"), "pos").alias("id"), F.col("embedding").alias("values"), F.struct("cluster").alias("metadata"), "pos")


DOT = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(sql(f" SELECT round({DOT}, 6) AS score, 'doc_' || v.pos AS id, v.cluster FROM vecs v, vecs q WHERE q.pos = (SELECT min(pos) FROM vecs) ORDER BY {DOT} DESC, 2 LIMIT 10", "vecs"))
def vector_topk(spark, sf_dir):
    v = stored_vectors(spark, sf_dir)
    found = vectors.search(v, v.orderBy("pos").first()["values"])
    return found.withColumn("score", F.round("score", 6))


@query(sql(f""", s AS (SELECT q.pos AS query_id, 'doc_' || v.pos AS id, {DOT} AS s FROM vecs v, vecs q WHERE q.pos % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id))::INT AS rank FROM s) SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 5""", "vecs"))
def vector_topk_per_group(spark, sf_dir):
    v = stored_vectors(spark, sf_dir)
    queries = v.filter("pos % 50 = 0").select(F.col("pos").alias("query_id"), F.col("values").alias("query"))
    return vectors.search_per_group(v, queries, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(sql(f""", s AS (SELECT q.pos AS query_id, 'doc_' || v.pos AS id, {DOT} AS s FROM vecs v, vecs q WHERE q.pos % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id))::INT AS rank FROM s) SELECT query_id, id, round(s, 6) AS score, rank FROM r WHERE rank <= 10""", "vecs"))
def vector_index_topk(spark, sf_dir):
    """The exact search of an inverted-file index over all records."""
    v = stored_vectors(spark, sf_dir)
    index = ivf.build(v, scratch(spark, "index"))
    queries = v.filter("pos % 50 = 0").select(F.col("pos").alias("query_id"), F.col("values").alias("query"))
    return ivf.search(index, queries, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(sql(""" SELECT 'doc_' || pos AS id, substr(title, 1, 200) AS title, substr("desc", 1, 500) AS "desc", kw, cafe, cluster FROM clustered WHERE pos % 4 > 0""", "clustered"))
def vector_records(spark, sf_dir):
    rows = views.clustered(spark, sf_dir).withColumn("embedding", F.array((F.col("pos") % 4).cast("float"), F.lit(0.0).cast("float")))
    return vectors.records(rows).select("id", "metadata.*")


@query(sql(" SELECT 'doc_' || pos AS id, CASE WHEN pos % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM vecs", "vecs"))
def vector_upsert(spark, sf_dir):
    """Old records, then new ones in the place of a third of them, in a bucketed table."""
    v = stored_vectors(spark, sf_dir).withColumn("version", F.lit("old"))
    table = Table.create(spark, scratch(spark, "vectors"), v.schema, dim=len(v.first()["values"]), metric="cosine")
    table.upsert(v)
    table.upsert(v.filter("pos % 3 = 0").withColumn("version", F.lit("new")))
    return table.read().select("id", "version")


@query("SELECT doc_id AS pos, substr('cx-' || lower(replace('S_' || repeat(source, 9), '_', '-')), 1, 45) AS name FROM documents")
def index_name(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), rules.index_name(F.concat(F.lit("S_"), F.repeat("source", 9))).alias("name"))


@query("""SELECT doc_id AS pos, least(30, 15 + n_chars // 100) AS node_size, 20 + floor(70.0::DOUBLE * (doc_id + 1) / (n_chars + doc_id + 1))::BIGINT AS progress,
CASE WHEN n_chars < 50 THEN 1 WHEN n_chars < 200 THEN 2 ELSE 3 END AS quota, CASE WHEN length(source || lang || source) > 8 THEN substr(source || lang || source, 1, 8) || '...' ELSE source || lang || source END AS short,
CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS round, CASE doc_id % 5 WHEN 0 THEN 'r2' WHEN 1 THEN 'r3' WHEN 2 THEN CASE WHEN doc_id < 160 THEN 'r3-expand' ELSE 'final' END ELSE 'final' END AS next_round,
CASE doc_id % 5 WHEN 4 THEN 0 ELSE 1 END AS step FROM documents""")
def scalar_rules(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("r1", "r2", "r3", "r3-expand", "elsewhere"))), (F.col("doc_id") % 5 + 1).cast("int"))
    d = views.table(spark, sf_dir, "documents").withColumn("r", name)
    return d.select(
        F.col("doc_id").alias("pos"), rules.node_size("n_chars").alias("node_size"), rules.progress(F.col("doc_id") + 1, F.col("n_chars") + F.col("doc_id") + 1).alias("progress"), rules.persona_quota("n_chars").alias("quota"),
        rules.short_name(F.concat("source", "lang", "source")).alias("short"), rules.round_number("r").alias("round"), rules.next_round("r", "doc_id").alias("next_round"), rules.step_index("r").alias("step"),
    )


@query("SELECT event_id, 's' || (epoch_us(ts) // 1000) AS sid FROM events")
def session_ids(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", rules.session_id(F.col("ts").cast("timestamp")).alias("sid"))


RUNS = "r AS (SELECT doc_id % 10 AS sid, doc_id // 10 % 3 AS run_ts, doc_id FROM documents)"


def runs(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("sid"), (F.floor(F.col("doc_id") / 10) % 3).alias("run_ts"), "doc_id")


@query(f"WITH {RUNS} SELECT sid, max(run_ts) AS run_ts, arg_max(doc_id, run_ts * 1000000000 + doc_id) AS doc_id FROM r GROUP BY sid")
def persona_latest(spark, sf_dir):
    return jobs.latest_by(runs(spark, sf_dir), ["sid"], "run_ts")


@query(f"WITH {RUNS} SELECT * FROM r")
def snapshot_union(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.filter("run_ts = 0").unionByName(r.filter("run_ts > 0"), allowMissingColumns=True)


@query(f"WITH {RUNS} SELECT * FROM r WHERE run_ts = (SELECT max(b.run_ts) FROM r b WHERE b.sid = r.sid)")
def snapshot_latest(spark, sf_dir):
    return latest_run(runs(spark, sf_dir)).select("sid", "run_ts", "doc_id")


@query(sql("SELECT pos, coalesce(link, '') AS link FROM posts WHERE pos % 3 = 2 AND coalesce(link, '') NOT IN (SELECT coalesce(link, '') FROM posts WHERE pos % 3 < 2)", "posts"))
def unseen_links(spark, sf_dir):
    """Posts of a third run whose link neither of the runs before has, by their filters."""
    p = views.posts(spark, sf_dir).select("pos", "link")
    seen = SeenLinks(spark, scratch(spark, "seen"))
    for run in (0, 1):
        seen.add(p.filter(F.col("pos") % 3 == run), str(run))
    return seen.unseen(p.filter(F.col("pos") % 3 == 2)).select("pos", text.dflt("link", "").alias("link"))


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def fallback_source(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return first_non_empty(d.filter("lang = 'none'"), d.filter("lang = 'en'")).select("doc_id")


@query("""SELECT conv_id AS cluster_id, 'talk ' || conv_id AS cluster_name, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1)::INT AS persona_idx,
role AS name, 'turn ' || turn AS situation, md5(text) AS pain_point, substr(text, 1, 60) AS insight FROM conversations""")
def persona_explode(spark, sf_dir):
    """Conversations as clusters whose turns are their personas."""
    turn = F.struct("turn", "role", F.md5("text").alias("pain_point"), F.concat(F.lit("turn "), "turn").alias("situation"), F.substring("text", 1, 60).alias("insight"))
    listed = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    people = F.transform("t", lambda x: F.struct(x["role"].alias("name"), x["situation"].alias("situation"), x["pain_point"].alias("pain_point"), x["insight"].alias("insight")))
    return personas.explode_personas(listed.select(F.col("conv_id").alias("cluster_id"), F.concat(F.lit("talk "), "conv_id").alias("cluster_name"), people.alias("personas")))


GRAPH = """, n AS (SELECT cluster + 1 AS cluster_id, count(*) AS size FROM clustered GROUP BY 1), c AS (SELECT p.*, coalesce(size, 0) AS size FROM personas p LEFT JOIN n USING (cluster_id)),
e AS (SELECT cluster_id, unnest(personas) AS p, generate_subscripts(personas, 1) - 1 AS i FROM personas)"""


@query(sql(GRAPH + """ SELECT 'center' AS id, 'thing' AS name, 'product' AS type, 40::BIGINT AS size, NULL::VARCHAR AS pain_point, NULL::VARCHAR AS insight
UNION ALL SELECT 'cluster_' || cluster_id, cluster_name, 'cluster', least(30, 15 + size // 100), NULL, NULL FROM c
UNION ALL SELECT 'persona_' || cluster_id || '_' || i, p.name, 'persona', 12, p.pain_point, p.insight FROM e""", "clustered", "personas"))
def sna_nodes(spark, sf_dir):
    return personas.build_graph(views.personas(spark), views.clustered(spark, sf_dir), "thing")[0]


@query(sql(GRAPH + """ SELECT 'center' AS source, 'cluster_' || cluster_id AS target, size AS value FROM c
UNION ALL SELECT 'cluster_' || cluster_id, 'persona_' || cluster_id || '_' || i, 1 FROM e""", "clustered", "personas"))
def sna_links(spark, sf_dir):
    return personas.build_graph(views.personas(spark), views.clustered(spark, sf_dir), "thing")[1]


@query(sql(""", n AS (SELECT cluster, count(*) AS size FROM clustered GROUP BY 1) SELECT cluster_id, cluster_name, size FROM personas LEFT JOIN n ON cluster = cluster_id - 1""", "clustered", "personas"))
def insights(spark, sf_dir):
    return personas.insights(views.personas(spark), clusters.sizes(views.clustered(spark, sf_dir))).select("cluster_id", "cluster_name", "size")


def canned(spark, sf_dir):
    """Answers of several forms, one for each document."""
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "source", "lang")
    k = F.col("pos") % 5
    made = F.when(k == 0, F.concat(F.lit('Here: [{"kw":"'), "source", F.lit('","cat":"'), "lang", F.lit('"}]\nADDED_KEYWORDS: '), "source", F.lit(", , x"))).when(k == 1, "no array").when(k == 2, "[1] and [2]").when(k == 3, F.concat(F.lit('Done\n```MODIFIED_DATA\n[{"cluster_id":1}]\n```\n'), "lang"))
    return d.select("pos", made.otherwise("```MODIFIED_DATA\n[]\n```").alias("answer"))


CANNED = """WITH a AS (SELECT doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN 'Here: [{"kw":"' || source || '","cat":"' || lang || '"}]' || chr(10) || 'ADDED_KEYWORDS: ' || source || ', , x' WHEN 1 THEN 'no array' WHEN 2 THEN '[1] and [2]'
WHEN 3 THEN 'Done' || chr(10) || '```MODIFIED_DATA' || chr(10) || '[{"cluster_id":1}]' || chr(10) || '```' || chr(10) || lang ELSE '```MODIFIED_DATA' || chr(10) || '[]' || chr(10) || '```' END AS answer FROM documents)"""


@query(CANNED + r""", s AS (SELECT pos, regexp_extract(answer, '\[[\s\S]*\]', 0) AS j FROM a) SELECT pos, CASE WHEN j = '' THEN 'empty' WHEN json_valid(j) THEN 'ok' ELSE 'error' END AS state,
CASE WHEN json_valid(j) AND j <> '' THEN json_extract_string(j, '$[0].kw') END AS kw FROM s""")
def llm_array_parse(spark, sf_dir):
    parsed = text.parse_array("answer", "struct<kw:string,cat:string>")
    return canned(spark, sf_dir).select("pos", text.answer_state("answer").alias("state"), F.get(parsed, F.lit(0))["kw"].alias("kw"))


@query(CANNED + r""", s AS (SELECT pos, list_filter(list_transform(string_split(regexp_extract(answer, 'ADDED_KEYWORDS:\s*(.+)', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS k FROM a) SELECT pos, array_to_string(k, '|') AS added FROM s""")
def added_keywords(spark, sf_dir):
    return canned(spark, sf_dir).select("pos", F.array_join(text.parse_added_keywords("answer"), "|").alias("added"))


@query(CANNED + r""" SELECT pos, CASE WHEN json_array_length(nullif(regexp_extract(answer, '```MODIFIED_DATA\s*\n([\s\S]*?)\n```', 1), '')) > 0 THEN regexp_extract(answer, '```MODIFIED_DATA\s*\n([\s\S]*?)\n```', 1) END AS modified,
regexp_replace(regexp_replace(regexp_replace(answer, '```MODIFIED_DATA\s*\n[\s\S]*?\n```', '', 'g'), 'ADDED_KEYWORDS:\s*.+', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM a""")
def modified_data(spark, sf_dir):
    return canned(spark, sf_dir).select("pos", text.modified_json("answer").alias("modified"), text.strip_directives("answer").alias("clean"))


@query(CANNED + r""" SELECT pos, array_to_string((list_transform(regexp_extract_all(answer, '[01]'), lambda x: x::INT) || [0, 0, 0, 0])[1:4], '') AS preds FROM a""")
def binary_preds(spark, sf_dir):
    return canned(spark, sf_dir).select("pos", F.array_join(F.transform(text.parse_binary_preds("answer", F.lit(4)), lambda x: x.cast("string")), "").alias("preds"))


@query("SELECT user_id AS sid, CASE WHEN user_id % 3 > 0 THEN 'b' || user_id ELSE '' END AS bk, CASE WHEN user_id % 3 > 0 THEN 'r1' ELSE '' END AS step FROM (SELECT DISTINCT user_id FROM events) ORDER BY sid DESC LIMIT 20")
def session_list(spark, sf_dir):
    sids = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("sid")).distinct()
    return jobs.session_list(sids, sids.filter("sid % 3 > 0").select("sid", F.concat(F.lit("b"), "sid").alias("bk"), F.lit("r1").alias("step")))


@query(sql(""", l AS (SELECT sid, job_type, arg_max(progress, struct_pack(ts := ts, progress := progress)) AS p FROM job_events GROUP BY ALL)
SELECT sid, max(p) FILTER (job_type = 'click') AS click, max(p) FILTER (job_type = 'view') AS view, max(p) FILTER (job_type = 'purchase') AS purchase FROM l GROUP BY sid""", "job_events"))
def pipeline_status(spark, sf_dir):
    return jobs.pipeline_status(views.job_events(spark, sf_dir), types=["click", "view", "purchase"])


@query(sql(""" SELECT sid, job_type, max(ts) AS ts, arg_max(event_id, struct_pack(ts := ts, event_id := event_id)) AS event_id FROM job_events GROUP BY ALL""", "job_events"))
def job_latest(spark, sf_dir):
    return jobs.latest_by(views.job_events(spark, sf_dir).select("sid", "job_type", "ts", "event_id"), ["sid", "job_type"], "ts")


@query(sql(""", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM job_events WINDOW w AS (PARTITION BY sid ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY sid ORDER BY ts, event_id) AS k FROM g) SELECT sid, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY sid, k""", "job_events"))
def job_session_windows(spark, sf_dir):
    from ..streaming.streams import job_sessions

    return job_sessions(views.job_events(spark, sf_dir))


@query(sql(""" SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, job_type, count(*) AS n, round(avg(progress), 6) AS progress FROM job_events GROUP BY ALL""", "job_events"))
def job_progress_windows(spark, sf_dir):
    from ..streaming.streams import progress_windows

    return progress_windows(views.job_events(spark, sf_dir)).withColumn("progress", F.round("progress", 6))


@query("""WITH p AS (SELECT doc_id AS pos, (doc_id % 10) / 10.0::DOUBLE AS a, (doc_id % 7) / 7.0::DOUBLE AS b, (doc_id % 3) / 3.0::DOUBLE AS c FROM documents)
SELECT pos, round((a + b + c) / 3, 6) AS relevance_score, (a + b + c) / 3 >= 0.5 AS is_relevant FROM p""")
def relevance_split(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), *((F.col("doc_id") % n / float(n)).alias(f"p{n}") for n in (10, 7, 3)))
    return classify.ensemble(d, ["p10", "p7", "p3"]).withColumn("relevance_score", F.round("relevance_score", 6))


@query()
def ensemble_score(spark, sf_dir):
    """The soft vote of three fitted models."""
    model = classify.fit_ensemble(views.labeled(spark, sf_dir))
    return model.score(views.posts(spark, sf_dir)).select("pos", "relevance_score", "is_relevant")


@query()
def kmeans_assign(spark, sf_dir):
    return clusters.assign(views.vecs(spark, sf_dir).drop("cluster"), 5).select("pos", "cluster")


@query()
def kmeans_k_search(spark, sf_dir):
    return spark.range(1).select(F.lit(clusters.choose_k(views.vecs(spark, sf_dir).drop("cluster"))).alias("k"))


NUMBER = "('0x' || substr(md5({0}), 1, 12))::BIGINT"
SEARCHED = f"""WITH k AS (SELECT text AS kw, row_number() OVER (ORDER BY item_id) - 1 AS kw_pos FROM benchmark), q AS (SELECT *, 'thing ' || kw AS query FROM k),
t AS (SELECT *, {NUMBER.format('query')} % 400 AS total FROM q), i AS (SELECT *, unnest(range(0, total)) AS i FROM t)
SELECT kw, kw_pos::INT AS kw_pos, (i // 100)::INT AS page, (i % 100)::INT AS item_pos, query || ' ' || i AS title, 'note ' || {NUMBER.format("query || '|' || i")} % 97 || ' on ' || query || ' & more' AS "desc",
'https://example.org/' || {NUMBER.format("query || '|' || (i // 2)")} AS link, 'club ' || {NUMBER.format("query || '|' || i")} % 7 AS cafe, '2024' || lpad((1 + i % 12)::VARCHAR, 2, '0') || lpad((1 + i % 28)::VARCHAR, 2, '0') AS date FROM i"""


@query(SEARCHED)
def search_source(spark, sf_dir):
    """All pages of the offline search service for the benchmark's texts as keywords."""
    spark.dataSource.register(SearchSource)
    asked = [r["text"] for r in views.table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").toLocalIterator()]
    return posts.from_search(spark.read.format("search").option("brand", "thing").option("keywords", json.dumps(asked)).load())


@query(f"""WITH {WORDS}, t AS (SELECT pos, kw, cat, {NUMBER.format("'thing ' || kw")} % 400 AS total FROM w) SELECT pos, kw, cat, total, {SCORE.format('total')} AS score FROM t""")
def keyword_totals(spark, sf_dir):
    return score_keywords(first_words(spark, sf_dir), "thing")


@query()
def embed_posts(spark, sf_dir):
    return embed(views.posts(spark, sf_dir).select("pos", "title", "desc"), text.post_text()).select("pos", "embedding")


@query(sql(r""", w AS (SELECT pos, list_filter(string_split(translate(lower(title || ' ' || "desc"), '!"#$%&()*+,-./:;<=>?@[\]^_`{|}~' || chr(9) || chr(10), '                                  '), ' '), lambda x: x <> '') AS w FROM posts),
e AS (SELECT pos, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM w), c AS (SELECT word, count(*) AS n, min(struct_pack(pos := pos, place := place)) AS f FROM e GROUP BY word),
v AS (SELECT word, row_number() OVER (ORDER BY n DESC, f) + 1 AS id FROM c QUALIFY id < 10000), s AS (SELECT pos, place, coalesce(id, 1) AS id FROM e LEFT JOIN v USING (word) WHERE place <= 200),
g AS (SELECT pos, string_agg(id::VARCHAR, ',' ORDER BY place) AS ids, count(*) AS n FROM s GROUP BY pos)
SELECT p.pos, md5(concat_ws(',', ids, nullif(rtrim(repeat('0,', (200 - coalesce(n, 0))::INT), ','), ''))) AS ids FROM posts p LEFT JOIN g USING (pos)""", "posts"))
def word_id_sequences(spark, sf_dir):
    """Each text as 200 word ids."""
    rows = views.posts(spark, sf_dir)
    return classify.token_ids(rows, classify.word_ids(rows)).select("pos", F.md5(F.array_join("ids", ",")).alias("ids"))


@query(sql(""", b AS (SELECT *, (row_number() OVER (ORDER BY pos) - 1) // 20 AS batch FROM posts), l AS (SELECT batch, pos, row_number() OVER (PARTITION BY batch ORDER BY pos) || '. ' || title || ' - ' || substr("desc", 1, 100) AS line FROM b)
SELECT batch, count(*) AS n, md5('Product: thing' || chr(10) || 'Problem: which' || chr(10) || 'Say of each post whether it is about the product, as 1 or 0 in order, with commas.' || chr(10) || string_agg(line, chr(10) ORDER BY pos)) AS prompt FROM l GROUP BY batch""", "posts"))
def batch_label_prompts(spark, sf_dir):
    """The prompts by which a language model labels posts in batches."""
    return classify.batch_prompts(views.posts(spark, sf_dir), "thing", "which").select("batch", "n", F.md5("prompt").alias("prompt"))


def filled(template: str, **columns: str) -> str:
    out = f"'{template}'"
    for name, column in columns.items():
        out = f"replace({out}, '{{{name}}}', coalesce({column}, ''))"
    return out


@query(f"""SELECT doc_id AS pos, {filled(keywords.GENERATE, bk='source', problem="split_part(text, ' ', 1)", target='lang')} AS first_round,
{filled(keywords.EXPAND, bk='source', problem="split_part(text, ' ', 1)", known="lang || ', ' || source")} AS later_round, {filled(keywords.SUGGEST, bk='source', cat='lang')} AS suggest FROM documents""")
def keyword_prompts(spark, sf_dir):
    """The prompts of a first round, of a later one, and for words beside a category."""
    bk, cat, problem = F.col("source"), F.col("lang"), F.split_part("text", F.lit(" "), F.lit(1))
    return views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), keywords.prompt(keywords.GENERATE, bk=bk, problem=problem, target=cat).alias("first_round"),
        keywords.prompt(keywords.EXPAND, bk=bk, problem=problem, known=F.concat_ws(", ", cat, bk)).alias("later_round"), keywords.prompt(keywords.SUGGEST, bk=bk, cat=cat).alias("suggest"),
    )


@query("""SELECT doc_id AS pos, CASE WHEN doc_id % 2 = 0 THEN source END AS word, CASE WHEN doc_id % 2 = 0 THEN lang END AS type FROM documents WHERE doc_id % 2 = 0""")
def suggested_words(spark, sf_dir):
    """Words with their types out of answers, of which some hold no array."""
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('So: [{"word":"'), "source", F.lit('","type":"'), "lang", F.lit('"}]'))).otherwise("none")
    answers = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), made.alias("answer"))
    return keywords.suggested(answers, "pos")


@query("SELECT lang AS cat, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY lang")
def keyword_category_totals(spark, sf_dir):
    return keywords.category_totals(first_words(spark, sf_dir))


@query("SELECT doc_id // 4 AS pos, CASE WHEN doc_id % 4 < 2 THEN 'a' ELSE 'b' END AS origin, doc_id AS value FROM documents")
def stored_lines(spark, sf_dir):
    """Rows written as JSON Lines under two folders with files of equal names, and read again by their prefix."""
    root = scratch(spark, "lines")
    d = views.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("pos"), F.when(F.col("doc_id") % 4 < 2, "a").otherwise("b").alias("origin"), F.col("doc_id").alias("value"))
    for origin in ("a", "b"):
        write_lines(d.filter(F.col("origin") == origin).withColumnRenamed("pos", "own_pos"), f"{root}/{origin}")
    return read_lines(spark, root, "", "own_pos bigint, origin string, value bigint").select(F.col("own_pos").alias("pos"), "origin", "value")


@query(f"WITH {RUNS} SELECT sid, max(run_ts) AS run_ts, count(*) AS n FROM r WHERE run_ts = (SELECT max(b.run_ts) FROM r b WHERE b.sid = r.sid) AND sid = 3 GROUP BY sid")
def stored_stage_latest(spark, sf_dir):
    """A session's latest run, from a stage table that several runs were appended to."""
    root, r = scratch(spark, "stage"), runs(spark, sf_dir)
    for run in range(3):
        write_stage(r.filter(F.col("run_ts") == run).filter("sid = 3").select("doc_id"), root, "posts", "3", str(run))
    rows = read_stage(spark, root, "posts", "3", "doc_id bigint", "latest")
    return rows.groupBy(F.col("sid").cast("long").alias("sid"), F.col("run_ts").cast("long").alias("run_ts")).agg(F.count("*").alias("n"))


@query()
def persona_answers(spark, sf_dir):
    return personas.parse_personas(complete(personas.persona_prompt(views.clustered(spark, sf_dir), "thing"))).select("bk", "state")


@query(f"SELECT doc_id AS pos, CASE WHEN trim(source) = '' OR doc_id % 9 = 0 THEN '{BLANK}' ELSE source END AS text FROM documents")
def blank_placeholder(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), text.non_blank(F.when(F.col("doc_id") % 9 == 0, " 　").otherwise(F.col("source")), BLANK).alias("text"))


@query("SELECT doc_id AS pos, coalesce(nullif(concat_ws(' | ', CASE WHEN doc_id % 2 = 0 THEN lang || ', ' || source END, CASE WHEN doc_id % 3 = 0 THEN lang END), ''), 'everyone') AS target FROM documents")
def target_desc(spark, sf_dir):
    none = F.array().cast("array<string>")
    d = views.table(spark, sf_dir, "documents")
    groups = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(none), none, F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(none)
    return d.select(F.col("doc_id").alias("pos"), rules.target_desc(*groups).alias("target"))


@query(f"WITH {WORDS} SELECT pos, kw, CASE WHEN pos % 8 = 3 THEN 'moved' ELSE cat END AS cat FROM w WHERE kw NOT IN (SELECT kw FROM old WHERE kw IS NOT NULL)")
def keyword_move(spark, sf_dir):
    """Words of one type that were not added, of which some change their category."""
    w = first_words(spark, sf_dir)
    left = keywords.word_types(w.withColumns({"word": F.col("kw"), "type": F.lit("adjective")}), w.filter("pos % 3 = 0").select(F.col("kw").alias("word")), "adjective")
    moved = keywords.move_keyword(left.withColumns({"round": F.lit(1), "id": F.col("pos") % 8}), 1, 3, "moved")
    return moved.select("pos", "kw", "cat")


@query("WITH t AS (SELECT doc_id, source, lang FROM documents ORDER BY doc_id DESC LIMIT 10) SELECT string_agg('- ' || source || ', ' || lang || ': ' || source || ', ' || lang || chr(10), '' ORDER BY doc_id) AS examples FROM t")
def naming_examples(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return personas.naming_examples(d.select(F.col("doc_id").alias("pos"), F.col("source").alias("industry"), F.col("lang").alias("cluster"), F.array("source", "lang").alias("personas")))


@query("WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant') SELECT conv_id, max(turn) AS turn, arg_max(md5(text), turn) AS answer FROM c GROUP BY conv_id")
def chat_latest(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return jobs.latest_by(c.select("conv_id", "turn", F.md5("text").alias("answer")), ["conv_id"], "turn")


@query()
def chat_prompt(spark, sf_dir):
    """The prompt of a chat turn over clusters and the posts nearest to the question."""
    rows = embed(views.clustered(spark, sf_dir), text.post_text())
    hits = vectors.search(vectors.records(rows), OfflineEmbedder().embed(["the house"])[0], 5)
    return personas.chat_prompt("What do they need?", views.clustered(spark, sf_dir), hits)


STATUS = "CASE WHEN event_id % 5 IN (0, 1) THEN 'running' WHEN event_id % 5 = 4 THEN 'error' ELSE 'done' END"


@query(f"""WITH e AS (SELECT DISTINCT user_id AS sid, event_type AS job_type, ts, {STATUS} AS status FROM events),
o AS (SELECT sid, job_type, ts, min(CASE status WHEN 'running' THEN 0 WHEN 'done' THEN 1 ELSE 2 END) AS k FROM e GROUP BY ALL),
l AS (SELECT *, lag(k) OVER w AS before, lag(ts) OVER w AS since, lead(ts) OVER w AS after FROM o WINDOW w AS (PARTITION BY sid, job_type ORDER BY ts)),
s AS (SELECT sid, job_type, ts, CASE k WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'error' END AS status FROM l WHERE k = 0 OR before = 0 AND ts <= since + INTERVAL 6 HOUR
UNION ALL SELECT sid, job_type, ts + INTERVAL 6 HOUR, 'timeout' FROM l WHERE k = 0 AND after > ts + INTERVAL 6 HOUR)
SELECT sid, job_type, ts, status FROM s""")
def job_transitions(spark, sf_dir):
    """The state changes that a job's rules accept, with its timeouts."""
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_type").alias("job_type"), "ts", F.expr(STATUS).alias("status"))
    return jobs.transitions(e)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts, filtered, deduplicated in order, counted by club."""
    return cafe_stats(spark, sf_dir)
