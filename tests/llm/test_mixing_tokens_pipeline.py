import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import mixing, queries, tokens
from tidemark.llm.common import shared_dir


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZER)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "  a", "a  b", "a b ", "a\n\nb c", "x \n y", "it's we'll I'M", "a b c  d", "日本語 テスト", "1 23 a1b2", "<|endoftext|> x", "\x1c y \x1f", "é̈ ñ", "a \tb", "😀 😀😀"]


def test_encoder_equals_the_library():
    import pyarrow as pa

    e = tokens.Encoder(queries.TOKENIZER)
    for _ in range(2):
        ids, sizes = e.encode(pa.array(ODD))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(ODD)


def test_encoder_asks_the_model_for_many_pieces_at_once(monkeypatch):
    """Pieces of a batch go to the library in a few calls, one for each PORTION of a kind of words."""
    import pyarrow as pa

    texts = [*ODD, *(" ".join(f"w{chr(97 + j % 26) * (j % 7)}{'ñ.' * (j % 3 == 0)} x{i * j}" for j in range(60)) for i in range(30)), "a\nb\n c\xa0 d"]
    e, calls = tokens.Encoder(queries.TOKENIZER), []

    class Counted:
        def __init__(self, model):
            self.ask = model.encode_batch_fast

        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return self.ask(texts, **how)

    e.model = Counted(e.model)
    got = lambda: (lambda ids, sizes: [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])])(*e.encode(pa.array(texts)))
    assert got() == library(texts) and 0 < sum(calls) <= 3
    e.known, e.ids, e.sizes = e.known[:0], e.ids[:0], e.sizes[:0]
    monkeypatch.setattr(tokens, "PORTION", 3)
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    assert got() == got() == library(texts) and len(e.known) == 10


@pytest.mark.parametrize("length", [8, 2048])
def test_tokens_round_trip(make, corpus, length):
    docs = make([*corpus, *enumerate(ODD, 200)], 3)
    path = shared_dir(docs.sparkSession, "test")
    shards = tokens.write_tokens(docs, path, queries.TOKENIZER, length=length, rows=4)
    got = sorted((tuple(r)[:4] for r in tokens.read_tokens(shards).collect()), key=lambda r: r[1])
    every = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for (i, _), ids in zip(every, library([t for _, t in every])):
        ids = [*ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    first = shards.orderBy("start").first()
    shard = tokens.Shard(first.file)
    assert shard.document(0).tolist()[-1] == 0
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == length and mask[0].as_py()
    last, mask = shard.sequence((first.n_tokens - 1) // length)
    assert sum(mask.to_pylist()) == (first.n_tokens - 1) % length + 1


def test_tokens_of_an_empty_table(make):
    assert tokens.token_table(make([]), queries.TOKENIZER).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left / total > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * left / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return out


def test_mixing(make, corpus):
    docs = make(corpus)
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for r in plan:
        sizes[r.source] += r.size
    want = brute_targets(sizes)
    assert len(plan) == len(corpus)
    for r in plan:
        assert r.size == len((r.text or "").split()) - (r.text or "").count(" ") * 0 or " " in r.text
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.copies <= 2
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in plan)
    clash = docs.selectExpr("doc_id", "text", "source", "777L AS size", "'mine' AS target", "'s' AS _source", "1 AS copies", "2 AS _copy", "3 AS row", "4 AS of")
    rows = mixing.mix(clash).collect()
    assert mixing.mix(clash).columns == clash.columns and all(tuple(r)[3:] == (777, "mine", "s", 1, 2, 3, 4) for r in rows) and len(rows) == out.count()
    assert rows_of(mixing.mix_plan(make(corpus, 5)).select("doc_id", "copies")) == rows_of(mixing.mix_plan(docs).select("doc_id", "copies"))


def test_mixing_meets_targets_and_sql(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", None if i % 11 == 0 else "s" + "ab"[i % 2] * (1 + i % 3), 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix_plan(docs).selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken", "source")
    taken, target = Counter(), {}
    for r in plan.collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] for s in target)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cols = "doc_id, size, source_size, target, taken"
    assert rows_of(plan.select(*cols.split(", "))) == sorted(con.sql(f"SELECT {cols} FROM ({mixing.ORACLE_SQL})").fetchall(), key=repr)


def test_mixing_of_an_empty_table(make):
    assert mixing.mix(make([])).count() == 0
    assert mixing.mix_plan(make([(1, None), (2, "")])).count() == 2


def test_keep_first_of_repeated_rows(make):
    from tidemark.llm import neardup

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, text), (2, text), (3, "other words"), (3, "different text"), (None, "a b"), (None, "a b"), (4, None), (4, None)]
    got = rows_of(neardup.keep_first(make(rows)).select("doc_id", "text"))
    assert got == sorted([(1, text), (3, "other words"), (3, "different text"), (None, "a b"), (4, None)], key=repr)


def test_keep_first_joins_only_rows_that_may_go(make, spark, monkeypatch, tmp_path):
    """Rows whose id is neither a copy's, nor repeated, nor null, stay without a join; tables between are removed."""
    from tidemark.llm import neardup

    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    docs = make([(i, text(i)) for i in range(200)] + [(300, text(7)), (301, text(7)), (8, "another text"), (None, "no id")]).withColumnsRenamed({"size": "_word", "score": "_id"})
    asked, parted = [], neardup.parted

    def seen(rows, wanted, keys):
        asked.append(parted(rows, wanted, keys))
        return asked[-1]

    monkeypatch.setattr(neardup, "parted", seen)
    monkeypatch.setattr(neardup, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    left = neardup.keep_first(docs)
    assert left.columns == docs.columns
    assert rows_of(left.select("doc_id", "text")) == sorted([*((i, text(i)) for i in range(200)), (8, "another text"), (None, "no id")], key=repr)
    may_go, stay = asked[-1]
    assert {r.doc_id for r in may_go.collect()} == {300, 301, 8, None} and stay.count() == 199
    assert {x.name for x in tmp_path.iterdir()} == {"classes", "odd"}


def test_pipeline_of_empty_tables_and_further_columns(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, rep long, row long"
    for name, rows in (("none", []), ("some", [(i, " ".join(f"w{j * 7919 % 50}x{i}" for j in range(40)), "en", "s", 1, 5, "t", 6, 7) for i in range(6)] * 2)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for stage in ("quality", "near_duplicates", "decontamination", "mixing"):
            docs = dict(corpus_pipeline.STAGES)[stage](spark, docs, at)
            assert docs.columns == spark.read.parquet(f"{at}/documents.parquet").columns
            if stage != "mixing":
                assert docs.count() == (0 if not rows else 12 if stage == "quality" else 6)
        assert all(tuple(r)[5:] == (5, "t", 6, 7) for r in docs.collect())
        assert (corpus_pipeline.run(spark, at).count() > 0) == bool(rows)


def test_pipeline(spark, tmp_path):
    """The stages one by one against plain Python on a small table."""
    import random

    import corpus_pipeline

    r = random.Random(8)
    vocabulary = [a + b + c for a in "bdgklmn" for b in "aeiou" for c in ("", "n", "s")]
    say = lambda n=40: " ".join(r.choice(vocabulary) for _ in range(n))
    good = [(i, say()) for i in range(60)]
    item = say(14)
    docs = good + [(100 + i, t) for i, t in good[:5]] + [(200, good[9][1] + " extra"), (210, f"{say(30)} {item} {say(30)}"), (220, "SPAM!! " * 40), (221, None)]
    docs += [(300 + i, " ".join(f"BUY{r.randint(0, 99)}!!" for _ in range(40))) for i in range(40)]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in docs if i < 60 or i >= 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, table, seen = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, at)
        out.write.parquet(f"{at}/{name}")
        table = spark.read.parquet(f"{at}/{name}")
        seen.append(table)
    assert all(t.columns == ["doc_id", "text", "lang", "source", "n_chars"] for t in seen[:-1])
    ids = [{x.doc_id for x in t.select("doc_id").collect()} for t in seen]
    clean = {i for i, _ in docs if i < 220}
    assert ids[0] == clean
    assert ids[1] == clean - {100, 101, 102, 103, 104, 200}
    texts = {x.doc_id: x for x in seen[2].collect()}
    assert {*texts} == ids[1] and item not in texts[210].text and texts[210].n_chars == len(texts[210].text) and texts[3].text == good[3][1]
    assert ids[3] <= ids[2] and seen[3].count() == seen[4].count()
    assert rows_of(corpus_pipeline.run(spark, at).select("doc_id", "n_tokens", "ids_crc32")) == rows_of(seen[4].select("doc_id", "n_tokens", "ids_crc32"))
