"""The search source's push-down and stream, the sink's commit, job states, and guards."""

import collections
import datetime as dt
import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.operators import jobs, keywords, posts
from tidemark.plans import stages
from tidemark.sources import providers, sinks, storage
from tidemark.streaming import streams


@pytest.fixture(scope="module")
def service():
    """350 items a keyword, one a day back from 2024-12-30, and a list of the pages that were asked for."""
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            start = int(q["start"])
            asked.append((q["query"], (start - 1) // 100))
            day = lambda i: (dt.date(2024, 12, 31) - dt.timedelta(days=i)).strftime("%Y%m%d")
            items = [{"title": f"{q['query']} {i}", "description": "d", "link": f"{q['query']}/{i}", "cafename": "c", "postdate": day(i)} for i in range(start, min(351, start + int(q["display"])))]
            data = json.dumps({"total": 350, "items": items}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def test_filters_end_the_search(spark, service):
    url, asked = service
    spark.dataSource.register(providers.SearchSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = spark.read.format("search").option("brand", "b").option("keywords", '["x", "y", "z"]').option("provider", url).option("push", "true")
    asked.clear()
    rows = source.load().filter("kw IN ('x', 'z') AND postdate >= '20240901'").collect()
    assert len(rows) == 2 * 121 and sorted(asked) == [("b x", 0), ("b x", 1), ("b z", 0), ("b z", 1)], "pages before the bound only"
    asked.clear()
    assert source.load().filter("kw = 'y' AND page < 1").count() == 100 and asked == [("b y", 0)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    asked.clear()
    assert source.option("push", "false").load().count() == 3 * 350 and len(asked) == 15, "four full pages and the empty one"


def test_target_ends_the_crawl(spark, service, tmp_path):
    url, asked = service
    settings = storage.Settings(root=f"file://{tmp_path}/w", search=url)
    asked.clear()
    stages.collect(spark, settings, "s", run="r", brand="b", keywords=[f"k{i}" for i in range(6)], target=500, wave=1, date_from="2024-06-01")
    assert {q for q, _ in asked} == {"b k0", "b k1", "b k2"} and max(p for _, p in asked) == 2, "three keywords have 500 posts since then"
    got = spark.read.parquet(f"{settings.root}/raw")
    assert got.count() == 500 and {r.kw for r in got.select("kw").distinct().collect()} == {"k0", "k1", "k2"}
    for bad in ({"brand": " ", "keywords": ["k"]}, {"brand": "b", "keywords": []}, {"brand": "b", "keywords": [" "]}):
        with pytest.raises(ValueError, match="given"):
            stages.collect(spark, settings, "s", run="r", **bad)


def test_search_stream_resumes(spark, service, tmp_path):
    url, asked = service
    spark.dataSource.register(providers.SearchSource)
    asked.clear()

    def run():
        stream = spark.readStream.format("search").options(brand="b", keywords='["x", "y"]', provider=url, pages=4, pages_a_batch=3, lanes=2, progress=f"file://{tmp_path}/progress").load()
        streams.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()

    run()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    assert first == 300 and len(asked) == 3, "the first batch's budget"
    for _ in range(3):  # each a restart
        run()
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == rows.select("link").distinct().count() == 700, "no loss and no repeats"
    assert max(collections.Counter(asked).values()) == 1


def test_sink_commits_whole_runs(spark, tmp_path):
    spark.dataSource.register(sinks.LinesSink)
    path = f"{tmp_path}/run"
    df = spark.range(1250).select(F.col("id"), F.lit("é").alias("kw"), F.lit(None).cast("string").alias("title")).coalesce(1)
    df.write.format("lines").option("path", f"file://{path}").mode("append").save()
    sizes = sorted(len(f.read_text().splitlines()) for f in (tmp_path / "run").glob("*.jsonl"))
    assert sizes == [250, 500, 500] and spark.read.json(path).count() == 1250 and [x.name for x in (tmp_path / "run").iterdir() if not x.is_file()] == []
    assert '"é"' in next((tmp_path / "run").glob("*.jsonl")).read_text()

    @F.udf("long")
    def breaks(i):
        if i == 999:
            raise ValueError("no")
        return i

    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            spark.range(1000).repartition(4).select(breaks("id").alias("id")).write.format("lines").option("path", f"file://{path}").mode(mode).save()
        assert spark.read.json(path).count() == 1250, "a failed task leaves no row"
    df.limit(580).write.format("lines").option("path", f"file://{path}").mode("overwrite").save()
    assert [len(f.read_text().splitlines()) for f in (tmp_path / "run").glob("*.jsonl")] == [580]


EVENT = "sid string, job_type string, ts timestamp, status string, n long"
HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 1)


def event(h, status, sid="a", n=1):
    return (sid, "crawl", START + h * HOUR, status, n)


def replayed(rows, hours=6):
    """The rules, event after event, in plain Python."""
    out, state = [], {}
    order = {"running": 0, "done": 1, "error": 2}
    for sid, kind, ts, status in sorted({r[:4] for r in rows}, key=lambda r: (r[2], order[r[3]])):
        at, running = state.get(sid, (None, False))
        if at == ts:
            continue
        if running and ts > at + hours * HOUR:
            out.append((sid, kind, at + hours * HOUR, "timeout"))
            running = False
        if status == "running" or running:
            out.append((sid, kind, ts, status))
        state[sid] = (ts, status == "running")
    return sorted(out)


ROWS = [event(0, "running"), event(1, "running"), event(2, "done"), event(3, "done"), event(4, "error"), event(5, "running"), event(20, "done"), event(21, "running"), event(21, "error"), event(22, "error"), event(0, "done", "b"), event(1, "running", "b"), event(1, "running", "b"), event(7, "done", "b"), event(30, "running", "b"), event(60, "running", "b")]


def test_transitions(spark):
    got = sorted(tuple(r) for r in jobs.transitions(spark.createDataFrame(ROWS, EVENT)).collect())
    assert got == replayed(ROWS)
    assert [r[3] for r in got if r[0] == "a"] == ["running", "running", "done", "running", "timeout", "running", "error"]
    assert jobs.transitions(spark.createDataFrame([], EVENT)).count() == 0


def test_job_states_as_a_stream(spark, tmp_path):
    """Batch after batch with repeated and late events, the changes are those of the batch form; a last timeout comes by its timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    batches = [ROWS[:3], ROWS[3:6] + ROWS[:2], ROWS[10:13], [*ROWS[6:10], *ROWS[13:15], ROWS[2]], ROWS[15:], [event(90, "running", "c")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in/*")
        streams.to_table(streams.job_states(stream, late="48 hours"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    found = sorted(tuple(r)[:4] for r in got if r.sid != "c")
    assert found == replayed(ROWS)
    assert max(r.total for r in got if r.sid == "a") == 9, "repeated and late events are not counted again"
    spark.createDataFrame([event(300, "running", "d")], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/b=9")
    streams.to_table(streams.job_states(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in/*"), late="48 hours"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    late = {(r.sid, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert ("c", "timeout") in late and ("b", "timeout") in late
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_brands_score_their_own_keywords(spark):
    requests = spark.createDataFrame([("", "none"), ("two", "ask two"), ("one", "ask one")], "bk string, prompt string")
    old = spark.createDataFrame([], "pos long, kw string, cat string")
    answer = providers.OfflineCompleter({"ask": '[{"kw":"first","cat":"a"},{"kw":"second","cat":"a"}]'})
    made = {(r.bk, r.kw): r for r in keywords.generate(requests, old, answer).collect()}
    total = lambda bk, kw: providers.OfflineSearch().page(f"{bk} {kw}", 1, 1)["total"]
    assert {k: r.total for k, r in made.items()} == {(b, k): total(b, k) for b in ("one", "two") for k in ("first", "second")}
    assert {k: r.id for k, r in made.items()} == {("one", "first"): 1, ("one", "second"): 2, ("two", "first"): 3, ("two", "second"): 4}


def test_guards(spark):
    words = spark.createDataFrame([(0, "w")], "pos long, word string")
    for call in (lambda: keywords.manual_keywords(words, "b", " "), lambda: keywords.suggested_keywords(words, ""), lambda: posts.given(None, "brand"), lambda: posts.given([], "keywords")):
        with pytest.raises(ValueError, match="given"):
            call()


def test_scratch_needs_a_shared_folder_on_clusters(spark):
    class Session:
        conf = collections.namedtuple("C", "get")(lambda *_: None)
        sparkContext = collections.namedtuple("S", "master")("local-cluster[2,1,1024]")

    with pytest.raises(ValueError, match="checkpoint"):
        storage.scratch(Session, "x")


def test_embedding_asks_once_and_holds_one_batch(spark):
    from tidemark.operators import vectors

    asked = spark.sparkContext.accumulator(0)

    class Counting:
        dim = 4

        def embed(self, texts):
            asked.add(len(texts))
            if "text 5" in texts:
                raise OSError
            return [[float(t.split()[-1]) + 1, 0.5, 0, 1.0] for t in texts]

    rows = spark.range(0, 1000, 1, 2).select(F.col("id").alias("pos"), F.concat(F.lit("text "), "id").alias("title"), F.lit("").alias("desc"), F.lit("k").alias("kw"), F.lit("c").alias("cafe"), F.lit(0).alias("cluster"))
    made = providers.embed(rows, F.col("title"), Counting(), 64)
    got = {r.pos: r.embedding for r in made.collect()}
    assert all(got[i] == ([0] * 4 if i < 64 else [i + 1, 0.5, 0, 1]) for i in range(1000)) and asked.value == 1000
    asked.value = 0
    best = vectors.search(vectors.records(made), [1.0, 0.0, 0.0, 0.0], 2).collect()
    assert [r.id for r in best] == ["doc_999", "doc_998"] and asked.value == 1000, "the filter of zero vectors asks for none again"
