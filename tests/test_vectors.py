"""The bucketed table, the inverted-file index, k-means of many models, and the vocabulary, each against a plain form."""

import collections
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters, ivf, kmeans, vectors, vocabulary
from tidemark.sources import bucketed
from tidemark.sources.bucketed import Table
from tidemark.sources.storage import list_objects

ROW = "id string, v int, pos long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", 0, i) for i in range(60)], ROW)
    made = Table.create(spark, f"file://{tmp_path}/t", df.schema, buckets=8, dim=2)
    made.upsert(df)
    return made


def test_upsert_writes_touched_buckets_only(spark, table):
    before = table.manifest()
    table.upsert(spark.createDataFrame([("k3", 1, 5), ("k3", 2, 9), ("k3", 3, 7)], ROW), order="pos")
    after = table.manifest()
    changed = [b for b in before.files if before.files[b] != after.files[b]]
    assert len(changed) == 1 and after.version == before.version + 1, "other buckets keep their files"
    assert sorted((r.id, r.v) for r in table.read().collect()) == sorted((f"k{i}", 2 if i == 3 else 0) for i in range(60))
    assert table.read(before.version).filter("v > 0").isEmpty(), "a reader keeps its version"
    keys = spark.createDataFrame([("k3",), ("k4",), ("none",)], "id string")
    assert {r.id for r in table.lookup(keys).collect()} == {"k3", "k4"}
    table.remove(keys)
    assert table.read().count() == 58
    gone = table.vacuum(1)
    assert gone > 0 and table.read().count() == 58 and len(list_objects(spark, f"{table.root}/data")) == sum(map(len, table.manifest().files.values()))
    assert table.upsert(spark.createDataFrame([], ROW)).version == table.manifest().version, "no rows, no version"


def test_tables_have_fixed_properties(spark, table):
    schema = spark.createDataFrame([], ROW).schema
    assert Table.create(spark, table.root, schema, buckets=8, dim=2).manifest().version == table.manifest().version
    with pytest.raises(ValueError, match="dim"):
        Table.create(spark, table.root, schema, dim=3)


def test_two_writers(spark, table, monkeypatch):
    """The second of two writers merges anew where buckets overlap, and goes on where they do not."""
    lost = []
    real = Table._commit

    def late(self, made):
        if not lost:  # another one commits first
            lost.append(made)
            Table(spark, table.root).upsert(spark.createDataFrame([("k3", 7, 0), ("new", 7, 0)], ROW))
        return real(self, made)

    monkeypatch.setattr(Table, "_commit", late)
    table.upsert(spark.createDataFrame([("k3", 8, 0)], ROW))
    got = {r.id: r.v for r in table.read().collect()}
    assert got["k3"] == 8 and got["new"] == 7 and len(got) == 61
    busy = []

    def never_first(self, made):
        if not busy:
            busy.append(1)
            Table(spark, table.root).upsert(spark.createDataFrame([("k3", 9, 0)], ROW))
            busy.clear()
        return real(self, made)

    monkeypatch.setattr(Table, "_commit", never_first)
    monkeypatch.setattr(bucketed, "ATTEMPTS", 2)
    with pytest.raises(bucketed.Conflict):
        table.upsert(spark.createDataFrame([("k3", 1, 0)], ROW))


def test_many_writers(spark, table):
    def write(i):
        Table(spark, table.root).upsert(spark.createDataFrame([("shared", i, i), (f"own{i}", i, i)], ROW))

    each = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in each]
    [t.join() for t in each]
    got = {r.id for r in table.read().collect()}
    assert {"shared", "own0", "own1", "own2", "own3"} <= got and len(got) == 65


def test_vector_dimension_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "pos long, embedding array<float>").selectExpr("*", "'t' AS title", "'d' AS desc", "'k' AS kw", "'c' AS cafe", "0 AS cluster")
    root = f"file://{tmp_path}/v"
    assert vectors.indexed(spark, root) is None
    assert vectors.upsert_vectors(spark, root, df).count() == 1, "zero vectors are left out"
    with pytest.raises(ValueError, match="dimension 2"):
        vectors.upsert_vectors(spark, root, df.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert vectors.indexed(spark, root).count() == 1


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 12))
    v = centre[rng.integers(0, 20, 3000)] + 0.25 * rng.normal(size=(3000, 12))
    v[2000:2900] = v[2000]  # a third of all records are one vector
    rows = [(f"r{i}", x.tolist()) for i, x in enumerate(v)] + [("zero", [0.0] * 12), ("null", None)]
    return v, spark.createDataFrame(rows, "id string, values array<double>").repartition(4)


def nearest(v, q, k):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ (q / np.linalg.norm(q)), 12)
    return sorted(((-x, f"r{i}") for i, x in enumerate(s)))[:k]


def test_index_is_exact_and_ends_early(spark, cloud, tmp_path, monkeypatch):
    v, df = cloud
    index = ivf.build(df, f"file://{tmp_path}/i")
    assert index.records().count() == 3000 and index.dim == 12 and len(index.centres) == 55
    again = ivf.opened(spark, index.root)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 3000, 50)] + [(-1, [0.0] * 12), (-2, None), (-3, (-v[0]).tolist())], "query_id long, query array<double>")
    looked = []
    real = ivf._in_lists
    monkeypatch.setattr(ivf, "_in_lists", lambda *a: looked.append(a[-1].sum()) or real(*a))
    got = collections.defaultdict(list)
    for r in ivf.search(again, queries, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.id))
    assert got.keys() == {*range(0, 3000, 50), -3}
    for i, found in got.items():
        want = nearest(v, v[i] if i >= 0 else -v[0], 10)
        assert [x[1] for x in found] == [x[1] for x in want] and [x[0] for x in found] == pytest.approx([x[0] for x in want])
    assert sum(looked) < 0.75 * len(got) * len(index.centres), "most lists are ruled out by their bound"
    near = {(r.query_id, r.id) for r in ivf.search(index, queries, 10, exact=False).collect()}
    recall = np.mean([np.mean([(i, x[1]) in near for x in found]) for i, found in got.items() if i >= 0])
    assert recall >= 0.9
    small = ivf.search(index, queries, 10, block=7)
    assert small.count() == sum(map(len, got.values()))


def test_index_edges(spark, cloud, tmp_path):
    v, df = cloud
    with pytest.raises(ValueError, match="dimension"):
        ivf.build(df, f"file://{tmp_path}/x", dim=5)
    few = ivf.build(df.limit(0), f"file://{tmp_path}/none")
    queries = spark.createDataFrame([("a", v[0].tolist())], "query_id string, query array<double>")
    assert ivf.search(few, queries).count() == 0
    one = ivf.build(df.filter("id = 'r7'"), f"file://{tmp_path}/one")
    assert [r.id for r in ivf.search(one, queries, 3).collect()] == ["r7"]
    with pytest.raises(ValueError, match="12"):
        ivf.search(one, spark.createDataFrame([("a", [1.0])], "query_id string, query array<double>")).collect()


def lloyd(x, c, steps):
    for _ in range(steps):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        if np.sqrt(((new - c) ** 2).sum(1)).max() <= kmeans.TOLERANCE:
            return new
        c = new
    return c


def silhouette(x, own):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    out = []
    for i in range(len(x)):
        mine = (own == own[i]).sum()
        a = d[i][own == own[i]].sum() / max(1, mine - 1)
        b = min(d[i][own == j].mean() for j in set(own.tolist()) - {own[i]})
        out.append(0.0 if mine == 1 else (b - a) / max(a, b))
    return float(np.mean(out))


def test_models_advance_together(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 3)) + 6 * np.array(m) for m in ([0, 0, 0], [1, 0, 1], [0, 2, 0], [3, 1, 0])])
    df = spark.createDataFrame([(x_.tolist(),) for x_ in x] + [(None,)], "embedding array<double>").repartition(3)
    starts = [x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 4, 4, 5)]
    rows = df.filter("embedding IS NOT NULL")
    for got, c in zip(kmeans.advanced(rows, starts, 12), starts):
        assert np.allclose(got, lloyd(x, c, 12))
    fitted = kmeans.fit(df, [2, 3, 4, 5], 4)
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    assert cost(fitted[2]) > cost(fitted[3]) > cost(fitted[4]) > cost(fitted[5])
    scores = kmeans.silhouettes(df, fitted)
    for k, c in fitted.items():
        assert scores[k] == pytest.approx(silhouette(x, ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)))
    assert clusters.choose_k(df.filter("embedding IS NOT NULL")) == 4
    got = kmeans.assigned(df, fitted[4]).collect()
    assert [r.cluster for r in got if r.embedding is None] == [None] and len({r.cluster for r in got}) == 5


def test_models_of_few_rows(spark):
    same = spark.createDataFrame([([1.0, 1.0],)] * 5, "embedding array<double>")
    assert kmeans.silhouettes(same, kmeans.fit(same, [2, 3], 2)) == {}, "one cluster has no silhouette"
    assert {r.cluster for r in clusters.assign(same, 3, 2).collect()} == {0}
    assert clusters.assign(same.limit(0), 3).count() == 0 and clusters.choose_k(same.limit(0)) == 0


def test_passes_do_not_grow_with_the_models(spark):
    rows = [([float(i % 7), float(i % 3)],) for i in range(200)]
    df = spark.createDataFrame(rows, "embedding array<double>")
    calls = []
    real = kmeans.sums
    try:
        kmeans.sums = lambda *a: calls.append(len(a[1].starts) - 1) or real(*a)
        kmeans.choose_k(df, list(range(3, 15)), 10)
    finally:
        kmeans.sums = real
    assert calls[0] == 120 and len(calls) <= kmeans.STEPS + 2


def plain(rows, bigrams=True):
    terms = []
    for _, t in rows:
        w = re.findall(r"\w{2,}", (t or "").lower())
        terms.append(collections.Counter(w + ([f"{a} {b}" for a, b in zip(w, w[1:])] if bigrams else [])))
    return terms


@pytest.mark.parametrize("counters", [(200_000,), (40,), (5, 400)])
def test_vocabulary_is_exact_at_any_size_of_summaries(spark, counters):
    import random

    r = random.Random(3)
    rows = [(i, " ".join(f"W{min(int(r.expovariate(0.08)), 300)}" for _ in range(r.randint(0, 40)))) for i in range(150)] + [(200, None), (201, ""), (202, "a b c"), (203, "solo")]
    df = spark.createDataFrame(rows, "pos long, t string").repartition(5)
    each = plain(rows)
    total, df_of = sum(each, collections.Counter()), collections.Counter(t for c in each for t in c)
    ok = [t for t in total if 2 <= df_of[t] <= 0.6 * len(rows)]
    want = [(t, total[t], df_of[t]) for t in sorted(ok, key=lambda t: (-total[t], t))[:30]]
    words = vocabulary.tokens(df, F.col("t"))
    assert vocabulary.vocabulary(words, len(rows), 30, 2, 0.6, True, counters) == want
    got = collections.defaultdict(dict)
    for x in vocabulary.tfidf(df, F.col("t"), 30, 2, 0.6, counters=counters).collect():
        got[x.pos][x.term] = x.w
    for (i, _), c in zip(rows, each):
        raw = {t: c[t] * (np.log((1 + len(rows)) / (1 + d)) + 1) for t, _, d in want if c[t]}
        assert got.get(i, {}) == pytest.approx({t: v / np.sqrt(sum(y * y for y in raw.values())) for t, v in raw.items()})


def test_summaries_bound_what_they_lose():
    rng = np.random.default_rng(0)
    stream, summary = rng.zipf(1.3, 30_000) % 5000, vocabulary.Summary(100)
    for part in np.array_split(stream, 30):
        keys, n = np.unique(part.astype(np.uint64), return_counts=True)
        summary.add(keys, n)
    exact, kept = collections.Counter(stream.tolist()), dict(zip(summary.keys.tolist(), summary.n.tolist()))
    assert summary.taken <= len(stream) / 100 and all(0 <= n - kept.get(x, 0) <= summary.taken for x, n in exact.items())


def test_steps_bound_the_words_and_keep_every_row():
    import pyarrow as pa

    sizes = [3, 0, 5, 40, 2, 2, 0, 9, 1]
    batch = pa.record_batch([pa.array(range(9)), pa.array([[f"w{i}"] * n for i, n in enumerate(sizes)], pa.list_(pa.string()))], names=["pos", "w"])
    parts = [p.to_pylist() for p in vocabulary.steps(iter([batch, batch.slice(0, 0), batch.slice(2, 5)]), 10)]
    assert [r for p in parts for r in p] == batch.to_pylist() + batch.to_pylist()[2:7]
    assert all(len(p) == 1 or sum(len(r["w"]) for r in p) <= 10 for p in parts) and len(parts) == 7
    summary = vocabulary.Summary(50)
    for i in range(30):
        summary.add(np.arange(i, i + 5, dtype=np.uint64), np.ones(5, np.int64))
    summary.merge()
    assert summary.taken == 0 and summary.keys.tolist() == [*range(34)] and summary.n.sum() == 150


def test_nearest_keeps_k_of_many_copies():
    import types

    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 8)).astype(np.float32)
    v[500:2900] = v[7]  # copies, over several tiles
    asked = np.concatenate([v[[7]], rng.normal(size=(5, 8))]).astype(np.float64)
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    ids = [f"doc_{i}" for i in range(3000)]
    batches = [pa.record_batch([pa.array(ids[a:b]), pa.array(v[a:b].tolist(), pa.list_(pa.float32()))], names=["id", "values"]) for a, b in ((0, 0), (0, 2500), (2500, 3000))]
    (out,) = vectors._nearest(types.SimpleNamespace(value=([*range(6)], asked)), 4, pa.int64())(iter(batches))
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    for q in range(6):
        got = [(r["id"], r["score"]) for r in out.to_pylist() if r["query_id"] == q]
        score = np.round(np.array([sum(x) for x in (unit * asked[q]).tolist()]), 12)
        want = sorted(range(3000), key=lambda i: (-score[i], ids[i]))[:4]
        assert [x for x, _ in got] == [ids[i] for i in want] and [s for _, s in got] == pytest.approx([score[i] for i in want], abs=1e-9)
