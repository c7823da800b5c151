"""Operators on small in-line tables."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import classify, clusters, jobs, keywords, personas, posts, vectors
from tidemark.sources import providers, storage
from tidemark.streaming import streams

POST = "pos long, kw string, title string, desc string, link string, cafe string, date string"


def post(pos, title="a title", desc="a description", link=None, cafe="club", kw="k", date="20240101"):
    return (pos, kw, title, desc, link if link is not None else f"l{pos}", cafe, date)


def positions(df):
    return [r.pos for r in df.orderBy("pos").collect()]


def test_preprocess_order(spark):
    rows = [
        post(0, "abc", "short", "x"), post(1, link="x"),  # a short first row blocks its copy
        post(2, "an AD", link="y"), post(3, link="y"),  # a filtered first row does not
        post(4, link=""), post(5, link=""), post(6, "12345", "", "f"), post(7, "1234", "1234567890", "g"), post(8, "1234", "123456789", "h"), post(9, cafe="Bad Club"), post(10, None, None, "n"),
    ]
    df = spark.createDataFrame(rows, POST)
    out = posts.preprocess(df, ["ad"], ["bad"])
    assert positions(out) == [3, 4, 6, 7]
    again = posts.preprocess(out.drop("idx"), ["ad"], ["bad"])
    assert positions(again) == positions(out)
    assert positions(posts.preprocess(df, [""])) == []
    assert posts.counters(df, out).first().asDict() == {"original": 11, "filtered": 4}


def test_crawl_filters(spark):
    rows = [post(0, "Thing one"), post(1, "other"), post(2, "thing", cafe="중고나라 x"), post(3, "thing", date="20230101"), post(4, "thing", date=""), post(5, "thing", cafe="other")]
    df = spark.createDataFrame(rows, POST)
    assert positions(posts.crawl_filters(df, "THING", include=["club"], date_from="2024-01-01")) == [0, 4]
    assert positions(posts.take_target(df, ["kw", "pos"], 2)) == [0, 1]
    stats = posts.cafe_stats(df.withColumn("cafe", F.when(F.col("pos") > 0, F.col("cafe")))).collect()
    assert [(r.cafe, r["count"]) for r in stats] == [("club", 3), ("unknown", 1), ("중고나라 x", 1), ("other", 1)], "equal ones in the order seen"
    watched, total = posts.with_total(df)
    assert watched.count() == 6 and total.first().total == 6
    with pytest.raises(ValueError, match="posts"):
        posts.not_empty(df.limit(0), "posts")


def test_sample_and_batches(spark):
    df = spark.createDataFrame([post(i) for i in range(300)], POST)
    assert posts.label_sample(df, 1).count() == 10 and posts.label_sample(df, 5).count() == 15 and posts.label_sample(df, 50).count() == 20
    assert posts.label_sample(df.limit(0)).count() == 0
    got = {r.pos: r.batch for r in posts.with_batch(df.repartition(5), 128).collect()}
    assert got == {i: i // 128 for i in range(300)}


def test_keywords(spark):
    fresh = spark.createDataFrame([(0, "Old"), (1, "x"), (2, "new"), (3, "new"), (4, "")], "pos long, kw string")
    old = spark.createDataFrame([(0, "old", "c1"), (1, "word", "c2")], "pos long, kw string, cat string")
    assert positions(keywords.new_keywords(fresh, old)) == [2, 3]
    ranked = keywords.numbered_ranked(fresh.withColumn("score", F.col("pos") % 2)).collect()
    assert [r.id for r in ranked] == [2, 4, 1, 3, 5]
    words = spark.createDataFrame([(0, "OLD"), (1, "fresh"), (2, "Word"), (3, "after")], "pos long, word string")
    got = [(r.word, r.verdict) for r in keywords.manual_add_verdict(words, old, "c1").collect()]
    assert sorted(got) == [("OLD", "reject"), ("Word", "move"), ("fresh", "insert")]
    assert keywords.category_exists(old, " C1 ").first().taken and not keywords.category_exists(old, "c9").first().taken
    totals = keywords.category_totals(spark.createDataFrame([("a",), ("b",), ("b",)], "cat string")).collect()
    assert [tuple(r) for r in totals] == [("b", 2, 3), ("a", 1, 3)]
    added = keywords.manual_keywords(words, "", "c").collect()
    assert {r.id for r in added} == {"m_0", "m_1", "m_2", "m_3"} and all(r.score is not None and r.manual for r in added)
    assert {(r.id, r.score) for r in keywords.suggested_keywords(words, "c").collect()} == {(f"s_{i}", None) for i in range(4)}
    with pytest.raises(ValueError, match="brand"):
        keywords.generate(spark.createDataFrame([("", "P")], "bk string, prompt string"), old)
    requests = spark.createDataFrame([("thing", "P")], "bk string, prompt string")
    made = keywords.generate(requests, old, providers.OfflineCompleter({"P": 'So: [{"kw":"OLD","cat":"a"},{"kw":"nice","cat":"a"},{"kw":"good","cat":"b"}]'}))
    assert {r.kw for r in made.collect()} == {"nice", "good"} and made.schema["score"].dataType.typeName() == "integer"


def clustered(spark, n=20):
    rows = [(*post(i, f"word{i % 3} common text", f"more word{i % 2}", kw="ab"[i % 2]), i % 4) for i in range(n)]
    return spark.createDataFrame(rows, POST + ", cluster int")


def test_clusters(spark):
    df = clustered(spark)
    info = {r.cluster: r for r in clusters.cluster_info(df).collect()}
    assert info[0].size == 5 and info[0].keywords == ["a"] and info[1].keyword_counts == {"b": 5} and len(info[2].samples) == 3
    tied = spark.createDataFrame([(*post(0, kw="late"), 0), (*post(1, kw="soon"), 0)], POST + ", cluster int")
    assert [r.kw for r in clusters.top_keywords(tied).orderBy("rank").collect()] == ["late", "soon"]
    out = clusters.refine(df, [0, 2, 3], [2, 3])
    assert {(r.pos % 4, r.cluster) for r in out.collect()} == {(0, 0), (2, 1), (3, 1)}
    assert clusters.refine(df, [], [1]).count() == 20
    assert {r.cluster for r in clusters.refine(df, [1, 3]).collect()} == {0, 1}
    assert clusters.summary_text(df, 2).filter("cluster = 0").first().summary.count("\n") == 1


def test_tfidf(spark):
    df = clustered(spark)
    w = clusters.tfidf(df, F.col("title"), 50, min_df=2, max_df=0.95)
    assert {r.term for r in w.select("term").distinct().collect()} == {"word0", "word1", "word2", "word0 common", "word1 common", "word2 common"}
    norms = w.groupBy("pos").agg(F.sum(F.col("w") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)
    assert clusters.top_terms(w, df, 2).count() == 8
    hangul = spark.createDataFrame([(1, "가나 다라 마")], "pos long, t string")
    assert {r.term for r in clusters.terms(hangul, F.col("t")).collect()} == {"가나", "다라", "가나 다라"}


@pytest.mark.parametrize(("n", "ks"), [(29, []), (30, [3]), (39, [3]), (40, [3, 4]), (140, list(range(3, 15))), (1000, list(range(3, 15)))])
def test_candidate_ks(n, ks):
    assert list(clusters.candidate_ks(n)) == ks


def test_kmeans(spark):
    rows = [(i, [float(i % 3 * 10), float(i % 2) / 10]) for i in range(30)]
    df = spark.createDataFrame(rows, "pos long, embedding array<double>")
    got = {r.pos % 3: r.cluster for r in clusters.assign(df, 3, 2).collect()}
    assert len(set(got.values())) == 3 and clusters.choose_k(df) == 3 and clusters.choose_k(df.limit(4)) == 4


def test_vectors(spark, tmp_path):
    df = clustered(spark, 4).withColumn("embedding", F.array(F.col("pos").cast("float"), F.lit(1.0).cast("float") * (F.col("pos") > 0).cast("float")))
    made = vectors.records(df)
    assert made.count() == 3
    best = vectors.search(made, [1.0, 0.0], 2).collect()
    assert [r.id for r in best] == ["doc_3", "doc_2"] and best[0].kw == "b"
    queries = spark.createDataFrame([("q", [0.0, 1.0]), ("z", [0.0, 0.0])], "query_id string, query array<double>")
    for block in (1, 4096):
        near = vectors.search_per_group(made, queries, 2, block).collect()
        assert sorted((r.query_id, r.rank, r.id) for r in near) == [("q", 1, "doc_1"), ("q", 2, "doc_2")], "a zero vector has no neighbours"
    root = f"file://{tmp_path}/index"
    assert vectors.upsert_vectors(spark, root, df).count() == 3
    changed = df.filter("pos = 2").withColumn("title", F.lit("new")).union(df.filter("pos = 1"))
    after = vectors.upsert_vectors(spark, root, changed).collect()
    assert sorted((r.id, r.metadata.title == "new") for r in after) == [("doc_1", False), ("doc_2", True), ("doc_3", False)]
    both = storage.upsert(spark, made.withColumn("v", F.lit(1)), made.filter("id = 'doc_2'").withColumn("v", F.lit(2)))
    assert sorted((r.id, r.v) for r in both.collect()) == [("doc_1", 1), ("doc_2", 2), ("doc_3", 1)]


def test_personas(spark):
    people = spark.createDataFrame([(1, "one", [("n", "s", "p", "i")]), (9, "none", [])], "cluster_id int, cluster_name string, personas array<struct<name:string,situation:string,pain_point:string,insight:string>>")
    nodes, links = personas.build_graph(people, clustered(spark), "thing")
    ids = {r.id: r.size for r in nodes.collect()}
    assert ids == {"center": 40, "cluster_1": 15, "cluster_9": 15, "persona_1_0": 12}
    got = {(r.source, r.target): r.value for r in links.collect()}
    assert got == {("center", "cluster_1"): 5, ("center", "cluster_9"): 0, ("cluster_1", "persona_1_0"): 1}
    assert all(a in ids and b in ids for a, b in got)
    examples = spark.createDataFrame([(i, f"i{i}", "c", ["p", "q"]) for i in range(12)], "pos int, industry string, cluster string, personas array<string>")
    lines = personas.naming_examples(examples).first().examples.splitlines()
    assert len(lines) == 10 and lines[0] == "- i2, c: p, q"
    assert len(personas.naming_examples(examples.limit(3)).first().examples.splitlines()) == 3
    prompt = personas.persona_prompt(clustered(spark), "thing", examples)
    assert prompt.count() == 1 and "### Cluster 4 (5 posts, 1 keywords)" in prompt.first().prompt
    asked = {r.cluster: r.text for r in personas.retrieval_queries(clustered(spark)).collect()}
    assert asked[0] == "a a a a a" and asked[1] == "b b b b b"
    index = vectors.records(providers.embed(clustered(spark), F.concat("kw", F.lit(" "), "title")))
    hits = personas.retrieved(clustered(spark), index, k=2)
    assert {(r.cluster, r.rank) for r in hits.collect()} == {(c, k) for c in range(4) for k in (1, 2)}
    text = personas.persona_prompt(clustered(spark), "thing", examples, hits.filter("cluster = 0")).first().prompt
    assert text.count("\n- word") == 2 + 3 * 5, "two hits instead of the first posts of cluster 0"
    answered = providers.complete(prompt, providers.OfflineCompleter({"thing": '[{"cluster_id": 1, "cluster_name": "x", "personas": [{"name": "n"}]}]'}))
    row = personas.parse_personas(answered).first()
    assert row.state == "ok" and row.personas[0].personas[0].name == "n"
    states = personas.parse_personas(spark.createDataFrame([("none",), ("[{",), ("[{]",)], "answer string")).collect()
    assert [r.state for r in states] == ["empty", "empty", "error"]


def test_ensemble(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 0.4, 0.5, 0.5)], "pos int, a double, b double, c double")
    relevant, other = classify.split(classify.ensemble(df, ["a", "b", "c"]))
    assert [r.pos for r in relevant.collect()] == [1] and other.columns == ["pos"]
    with pytest.raises(ValueError, match="5"):
        classify.normalise_labels(spark.createDataFrame([("1",)] * 4, "label string"))
    rows = [(f"good thing {i}", "nice", '"relevant"') for i in range(12)] + [(f"bad stuff {i}", "poor", "0") for i in range(12)]
    labeled = spark.createDataFrame(rows, "title string, desc string, label string")
    seen = Observation("rows")  # what a session that counts by observe() has; models must not take it along
    assert labeled.observe(seen, F.count(F.lit(1)).alias("n")).count() == 24 and seen.get["n"] == 24
    model = classify.fit_ensemble(labeled, folds=2, trees=5, rounds=2)
    scored = model.score(labeled).collect()
    assert all(0 <= r.relevance_score <= 1 for r in scored) and sum(r.is_relevant == (r.label != "0") for r in scored) >= 22
    assert {r.model for r in model.cv_scores().collect()} == {"lr", "rf", "gbt"}


def test_scores_fit_no_folds(spark, monkeypatch):
    fitted, real = [], classify.detached
    monkeypatch.setattr(classify, "detached", lambda name, model, folder: fitted.append(folder.rpartition("/")[2]) or real(name, model, folder))
    rows = [(f"good thing {i}", "nice", '"relevant"') for i in range(12)] + [(f"bad stuff {i}", "poor", "0") for i in range(12)]
    labeled = spark.createDataFrame(rows, "title string, desc string, label string")
    model = classify.fit_ensemble(labeled, folds=2, trees=2, rounds=1)
    assert model.score(labeled).count() == 24 and sorted(fitted) == ["gbt", "lr", "rf"]
    accuracy = {r.model: r.accuracy for r in model.cv_scores().collect()}
    assert accuracy.keys() == {"lr", "rf", "gbt"} and all(0.5 < x <= 1 for x in accuracy.values())
    assert len(model.cv_scores().collect()) == 3 and len(fitted) == 3 + 2 * 3, "the folds are fitted once"


def test_fits_of_many_rows_have_many_tasks():
    assert [classify.fit_tasks(n) for n in (5, 2500, 20_000, 300_000)] == [1, 2, 12, 30]


def test_folds_are_stratified(spark):
    rows = [(i % 5 == 0, i) for i in range(60)]
    data = spark.createDataFrame([(int(y), i * 7919 % 1009) for y, i in rows], "y int, _h long")
    got = classify.with_folds(data, 3).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 20, 4), (1, 20, 4), (2, 20, 4)]


def test_features_have_smooth_idf(spark):
    import math

    rows = spark.createDataFrame([("aa bb", ""), ("aa cc", "")], "title string, desc string")
    vec = classify.fit_features(rows).transform(rows).collect()
    common, rare = 1.0, math.log(3 / 2) + 1
    assert all(sorted(r.features.values.tolist()) == pytest.approx(sorted(x / math.sqrt(common**2 + 2 * rare**2) for x in (common, rare, rare))) for r in vec)


def test_word_ids(spark):
    rows = spark.createDataFrame([(0, "B a, a!", "c"), (1, "b d", None), (2, None, "")], "pos long, title string, desc string")
    ids = classify.word_ids(rows)
    assert {r.word: r.id for r in ids.collect()} == {"b": 2, "a": 3, "c": 4, "d": 5}
    assert {r.pos: r.ids for r in classify.token_ids(rows, classify.word_ids(rows, 4), 5).collect()} == {0: [2, 3, 3, 1, 0], 1: [2, 1, 0, 0, 0], 2: [0] * 5}
    assert {r.pos: r.ids for r in classify.token_ids(rows, ids, 2).collect()}[0] == [2, 3]


def test_labels_from_a_service(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "d" * 150) for i in range(5)], "pos long, title string, desc string")
    prompts = [r.prompt for r in classify.batch_prompts(rows, "thing", "which", 3).orderBy("batch").collect()]
    assert len(prompts) == 2 and f"3. t2 - {'d' * 100}" in prompts[0].splitlines() and "2. t4" in prompts[1]
    got = classify.answered_labels(rows, "thing", "which", providers.OfflineCompleter({"t0": "1,0,1", "t3": "1"}), 3).collect()
    assert {r.pos: r.label for r in got} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0}
    scored = spark.createDataFrame([(True,), (False,), (True,)], "is_relevant boolean")
    assert tuple(classify.counters(scored).first()) == (3, 2, 1) and tuple(clusters.counters(clustered(spark)).first()) == (4, 20)


def test_storage(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.jsonl").write_text('{"kw":"1"}\n\nnonsense\n{"kw":"2"} tail\n{"kw":"3"}\n')
    (tmp_path / "raw/b.jsonl").write_text('{"kw":"4"}\n')
    assert [r.kw for r in storage.read_lines(spark, root, "raw/", "kw string").orderBy("pos").collect()] == ["1", "3", "4"]
    for folder in ("x", "y"):  # one name in two folders, and a file that is read in many splits
        (tmp_path / "many" / folder).mkdir(parents=True)
        (tmp_path / "many" / folder / "part.jsonl").write_text("".join(f'{{"kw":"{folder}{i}"}}\n' for i in range(3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    rows = storage.read_lines(spark, root, "many/", "kw string").orderBy("pos").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [r.kw for r in rows] == [f"{folder}{i}" for folder in "xy" for i in range(3000)] and len({r.pos for r in rows}) == 6000
    assert storage.read_lines(spark, root, "nothing/", "kw string").count() == 0
    df = spark.createDataFrame([("a", None)], "kw string, title string")
    storage.write_stage(df, root, "posts", "s1", "20240101_000000")
    storage.write_stage(df.union(df), root, "posts", "s1", "20240102_000000")
    storage.write_stage(df, root, "posts", "s2", "20240103_000000")
    read = lambda **k: storage.read_stage(spark, root, "posts", "s1", "kw string, title string", **k).count()
    assert read() == 3 and read(snapshot="latest") == 2
    assert storage.read_stage(spark, root, "none", "s1", "kw string").count() == 0
    assert storage.list_prefixes(spark, root, "posts") == ["sid=s1", "sid=s2"]
    storage.delete(spark, f"{root}/posts/sid=s2")
    storage.delete(spark, f"{root}/posts/sid=s2")
    assert storage.list_prefixes(spark, root, "posts") == ["sid=s1"]
    storage.write_document(df, f"{root}/doc.json")
    assert storage.read_document(spark, f"{root}/doc.json", "kw string, title string").first().kw == "a"
    assert storage.read_document(spark, f"{root}/no.json", "kw string").count() == 0
    assert storage.first_non_empty(df.limit(0), df).count() == 1
    storage.write_lines(df, f"{root}/lines")
    assert '"title":null' in spark.read.text(f"{root}/lines").first()[0]


def test_providers(spark):
    spark.dataSource.register(providers.SearchSource)
    found = spark.read.format("search").option("brand", "b").option("keywords", '["x","y"]').option("pages", 2).load()
    made = posts.from_search(found)
    assert found.count() > 0 and made.filter(F.col("title").contains("<")).count() == 0 and "cafe" in made.columns
    scored = providers.score_keywords(spark.createDataFrame([("x",), ("",)], "kw string"), "").collect()
    assert {r.kw: r.score for r in scored}[""] == 50
    texts = spark.createDataFrame([("red car",), ("red car",), (None,)], "t string")
    vecs = [r.embedding for r in providers.embed(texts, F.col("t"), providers.OfflineEmbedder(8), 2).collect()]
    assert vecs[0] == vecs[1] and len(vecs[2]) == 8
    class Broken:
        dim = 4

        def embed(self, texts):
            if "bad" in texts:
                raise RuntimeError
            return [[1.0] * 4] * len(texts)

        def complete(self, prompt, max_tokens):
            raise RuntimeError

    got = [r.embedding for r in providers.embed(spark.createDataFrame([("a",), ("bad",)], "t string").coalesce(1), F.col("t"), Broken(), 1).collect()]
    assert got == [[1.0] * 4, [0.0] * 4]
    assert providers.complete(spark.createDataFrame([("p",)], "prompt string"), Broken()).first().answer is None
    states = iter([{"status": "running"}, {"status": "done"}])
    assert providers.polled(lambda: next(states), pause=0)["status"] == "done"


def test_services_over_http(spark):
    import http.server
    import json
    import threading
    from urllib.parse import parse_qs, urlparse

    class Service(http.server.BaseHTTPRequestHandler):
        def answer(self, body, status=200):
            data = json.dumps(body).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            start = int(q["start"])
            if "fails" in q["query"]:
                return self.answer({"errorMessage": "no"})
            if "broken" in q["query"] and start > 100:
                return self.answer({}, 500)
            self.answer({"total": 350, "items": [{"title": f"<b>{q['query']}</b> {i}", "link": str(i)} for i in range(start, min(351, start + int(q["display"])))]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "input" in body:
                return self.answer({"data": [{"embedding": [float(len(t)), 1.0]} for t in body["input"]]})
            self.answer({"content": [{"text": self.headers["x-key"] + body["messages"][0]["content"]}]})

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    settings = storage.Settings(search=url, embedder=url, llm=url, llm_headers='{"x-key": "k"}')
    spark.dataSource.register(providers.SearchSource)
    found = spark.read.format("search").option("brand", "b").option("keywords", '["x", "fails", "broken"]').option("provider", url).load()
    assert {r.kw: r["count"] for r in found.groupBy("kw").count().collect()} == {"x": 350, "broken": 100}, "a failed page ends its keyword"
    totals = providers.score_keywords(spark.createDataFrame([("x",), ("fails",)], "kw string"), "b", providers.search_of(settings)).collect()
    assert {r.kw: (r.total, r.score) for r in totals} == {"x": (350, 55), "fails": (0, 50)}
    vec = providers.embed(spark.createDataFrame([("abc",)], "t string"), F.col("t"), providers.embedder_of(settings)).first().embedding
    assert vec == [3.0, 1.0]
    assert providers.complete(spark.createDataFrame([("p",)], "prompt string"), providers.completer_of(settings)).first().answer == "kp"
    server.shutdown()


def test_stages_from_search_to_personas(spark, tmp_path):
    from tidemark.plans import stages

    settings = storage.Settings(root=f"file://{tmp_path}/w", cache=f"file://{tmp_path}/c")
    clubs = stages.collect(spark, settings, "s1", brand="thing", keywords=["one", "two"], run="r1")
    assert clubs.count() == 7
    counts = stages.preprocess(spark, settings, "s1", run="r1").first()
    assert counts.original > counts.filtered > 0
    labeled = spark.createDataFrame([(f"thing one {i}", f"note {i}", '"relevant"') for i in range(9)] + [(f"thing two {i}", f"note {i}", "0") for i in range(9)], "title string, desc string, label string")
    trained = stages.train_and_score(spark, settings, "s1", run="r1", labeled=labeled, folds=2, trees=3, rounds=2).first()
    assert trained.total == counts.filtered and trained.relevant + trained.irrelevant == trained.total and 0 <= trained.lr <= 1
    info = stages.cluster(spark, settings, "s1", run="r1", num_clusters=3).collect()
    assert [r.cluster for r in info] == [0, 1, 2] and sum(r.size for r in info) == trained.relevant
    assert tuple(stages.refine(spark, settings, "s1", run="r1", merge=[0, 2]).first()) == (2, trained.relevant)
    assert stages.build_vectors(spark, settings, "s1", run="r1").count() == trained.relevant
    made = stages.make_personas(spark, settings, "s1", bk="thing", run="r1").first()
    assert made.num_clusters == 2 and made.personas == []
    with pytest.raises(ValueError, match="raw posts"):
        stages.preprocess(spark, settings, "none")
    states = jobs.latest_by(spark.read.parquet(f"{settings.root}/jobs"), ["sid", "job_type"], "ts").collect()
    assert {(r.sid, r.job_type): r.status for r in states} == {("s1", j): "done" for j in ("crawl", "preprocess", "train", "cluster", "refine", "embed", "persona")} | {("none", "preprocess"): "error"}


EVENT = "sid string, job_type string, ts timestamp, progress double"


def events(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    return spark.createDataFrame([("a", "crawl", at(0), 1.0), ("a", "crawl", at(5), 2.0), ("a", "train", at(30), 3.0), ("b", "crawl", at(1), 4.0)], EVENT)


def test_jobs(spark):
    status = {r.sid: r for r in jobs.pipeline_status(events(spark)).collect()}
    assert status["a"].crawl == 2.0 and status["a"].train == 3.0 and status["b"].train is None
    listed = jobs.session_list(spark.createDataFrame([("s1",), ("s2",)], "sid string"), spark.createDataFrame([("s1", "x", None)], "sid string, bk string, step string")).collect()
    assert [(r.sid, r.bk, r.step) for r in listed] == [("s2", "", ""), ("s1", "x", "")]
    assert jobs.insights_state(events(spark), events(spark)) == "graph" and jobs.insights_state(events(spark).limit(0), events(spark)) == "clusters"


def test_streams_match_batch(spark, tmp_path):
    df = events(spark).withColumn("link", F.col("sid"))
    for i, row in enumerate(df.collect()):
        spark.createDataFrame([row], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = EVENT + ", link string"
    run = lambda stream, name, mode="append": streams.to_table(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-ck", mode=mode).awaitTermination()
    run(streams.dedup_links(streams.read_stream(spark, f"{tmp_path}/in", schema, 10), within="3 days"), "links")
    assert spark.read.parquet(f"{tmp_path}/links").count() == 2
    seen = []
    streams.each_batch(streams.read_stream(spark, f"{tmp_path}/in", schema), lambda b, i: seen.append(b.count()), f"{tmp_path}/b-ck").awaitTermination()
    assert sum(seen) == 4
    assert streams.job_sessions(df).count() == 3 and streams.progress_windows(df).count() == 2
    assert streams.latest_jobs_stream(df).count() == 3


def test_sessions(spark, tmp_path):
    from tidemark.operators import sessions as ses

    root = f"file://{tmp_path}"
    assert ses.sessions(spark, root).count() == 0
    row = spark.createDataFrame([("s2", "thing", "r1")], "sid string, bk string, step string")
    ses.save_session(row, root, "s2")
    ses.save_session(row.withColumn("bk", F.lit("")), root, "s1")
    assert [(r.sid, r.bk) for r in ses.sessions(spark, root).collect()] == [("s2", "thing"), ("s1", "")]
    assert [r.sid for r in ses.with_brand(ses.sessions(spark, root)).collect()] == ["s2"]
    got = ses.get_session(spark, root, "s2")
    assert got.first().step == "r1" and ses.restored(got).columns[2] == "pd"
    change = spark.createDataFrame([("s2", None, "r2"), ("s3", "new", None)], "sid string, bk string, step string")
    assert sorted((r.sid, r.bk, r.step or "") for r in ses.merged(row, change).collect()) == [("s2", "thing", "r2"), ("s3", "new", "")]
    waiting = spark.createDataFrame([("1", "w", "c", 50, 7)], "id string, kw string, cat string, score int, total long")
    pending = ses.with_pending(got, waiting, "r2").first()
    assert pending._lastRound == "r2" and [x.kw for x in pending._pendingKw] == ["w"]
    next_, known = ses.approve_round(got.withColumn("allKw", F.array(F.struct(F.lit("0").alias("id"), F.lit("old").alias("kw")))), waiting.select("id", "kw"), "r3")
    assert next_.first().step == "r3" and sorted(r.kw for r in known.collect()) == ["old", "w"]
    ses.delete_session(spark, root, "s2")
    assert ses.get_session(spark, root, "s2").count() == 0


def test_chat(spark):
    df = clustered(spark, 8)
    hits = spark.createDataFrame([(0.5, "doc_1", "t1", "d1"), (0.9, "doc_2", "t2", "d2")], "score double, id string, title string, desc string")
    prompt = personas.chat_prompt("why?", df, hits).first().prompt
    assert "Cluster 4 (2 posts)" in prompt and prompt.index("t2") < prompt.index("t1") and "Personas:\nnone" in prompt
    answers = spark.createDataFrame([("b", "x\n```MODIFIED_DATA\n[{\"cluster_id\": 2, \"personas\": [{\"name\": \"n\"}]}]\n```"), ("b", "nothing")], "bk string, answer string")
    made = personas.written_back(answers, "20240101_000000").collect()
    assert len(made) == 1 and made[0].personas[0].cluster_id == 2 and made[0].personas[0].personas[0].name == "n"
