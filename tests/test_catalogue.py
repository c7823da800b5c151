"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name, tmp_path):
    df = catalogue.QUERIES[name](spark, DATA)
    df.write.parquet(f"{tmp_path}/out")
    columns = sorted(df.columns)
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    pick = ", ".join(f'"{c}"' for c in columns)
    rows = lambda q: sorted(map(repr, con.sql(f"SELECT {pick} FROM {q}").fetchall()))
    assert rows(f"'{tmp_path}/out/*.parquet'") == rows(f"({catalogue.ORACLES[name]})")


def test_queries_without_sql(spark):
    """Their results, but those of the models, which have tests of their own."""
    assert {*catalogue.QUERIES} - {*catalogue.ORACLES} == {"ensemble_score", "kmeans_assign", "kmeans_k_search", "embed_posts", "persona_answers", "chat_prompt"}
    assert [tuple(r) for r in catalogue.QUERIES["persona_answers"](spark, DATA).collect()] == [("thing", "ok")]
    prompt = catalogue.QUERIES["chat_prompt"](spark, DATA).first().prompt
    posts = [line for line in prompt.split("Related posts:")[1].split("Question:")[0].splitlines() if line.startswith("- ")]
    assert len(posts) == 5 and prompt.count("Cluster ") == 7 and "What do they need?" in prompt


def test_entry_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_posts_are_whole_texts(spark):
    from tidemark.plans import views
    from tidemark.sources.providers import MAX_CHARS, OfflineEmbedder

    texts = {r.doc_id: r.text for r in views.table(spark, DATA, "documents").select("doc_id", "text").collect()}
    assert any(len(t) > 500 for t in texts.values())
    for rows in (views.posts(spark, DATA), views.labeled(spark, DATA)):
        assert all(r.title + r.desc == texts[r.pos] for r in rows.collect())
    got = {r.pos: r.embedding for r in catalogue.QUERIES["embed_posts"](spark, DATA).collect()}
    ids = sorted(texts, key=lambda i: -len(texts[i]))[:5]
    want = OfflineEmbedder().embed([f"{texts[i][:80]} {texts[i][80:]}"[:MAX_CHARS] for i in ids])
    assert [got[i] for i in ids] == [pytest.approx(w, abs=1e-6) for w in want] and len(got) == len(texts)


def test_keyword_totals_scores_every_row(spark):
    from tidemark.plans import views

    assert catalogue.QUERIES["keyword_totals"](spark, DATA).count() == views.table(spark, DATA, "documents").count() > 100


def test_models_are_called_with_their_defaults(spark, monkeypatch):
    import inspect

    from tidemark.operators import classify, kmeans

    seen = []

    def record(module, name):
        real = inspect.signature(getattr(module, name))

        def call(*args, **named):
            bound = real.bind(*args, **named)
            bound.apply_defaults()
            seen.append((name, bound.arguments))
            raise InterruptedError

        monkeypatch.setattr(module, name, call)

    record(classify, "fit_ensemble")
    record(kmeans, "fit")
    for name in ("ensemble_score", "kmeans_assign", "kmeans_k_search"):
        with pytest.raises(InterruptedError):
            catalogue.QUERIES[name](spark, DATA)
    (_, ensemble), *fits = seen
    assert [ensemble[k] for k in ("folds", "trees", "rounds")] == [3, 100, 100]
    assert [f["n_init"] for _, f in fits] == [10, 10]
