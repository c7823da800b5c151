"""The cache of calls, links across runs, and sessions of several writers, each against a plain form."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sessions as ses
from tidemark.operators.seen import SeenLinks
from tidemark.sources import calls
from tidemark.sources.bucketed import Table
from tidemark.sources.providers import OfflineEmbedder
from tidemark.sources.storage import list_objects, newest_version, read_text, write_document

# ---- calls


class Noted:
    """Writes down each prompt that it is asked; `broken` makes its first calls fail."""

    def __init__(self, folder, broken=0):
        self.folder, self.broken = str(folder), broken

    def complete(self, prompt, max_tokens=2000):
        with open(f"{self.folder}/{time.time_ns()}-{os.getpid()}-{id(prompt)}", "w") as f:
            f.write(prompt)
        asked = sum(open(f"{self.folder}/{n}").read() == prompt for n in os.listdir(self.folder))
        if asked <= self.broken:
            raise OSError("busy")
        return None if prompt == "mute" else prompt.upper()

    def asked(self):
        return sorted(open(f"{self.folder}/{n}").read() for n in os.listdir(self.folder))


@pytest.fixture
def noted(tmp_path):
    (tmp_path / "asked").mkdir()
    return Noted(tmp_path / "asked")


def prompts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, prompt string")


def test_equal_prompts_are_asked_once(spark, tmp_path, noted):
    cache = calls.CallCache(spark, f"file://{tmp_path}/cache", tries=1)
    got = calls.complete(prompts(spark, "a", "b", None, "a", "", "mute"), noted, cache, "m").orderBy("i").collect()
    assert [r.answer for r in got] == ["A", "B", None, "A", "", None] and noted.asked() == ["", "a", "b", "mute"]
    got = calls.complete(prompts(spark, "b", "c", "mute"), noted, cache, "m").orderBy("i").collect()
    assert [r.answer for r in got] == ["B", "C", None] and noted.asked() == ["", "a", "b", "c", "mute", "mute"], "what failed is asked again"
    calls.complete(prompts(spark, "b"), noted, cache, "other").collect()
    assert noted.asked().count("b") == 2, "another model, another answer"
    assert calls.complete(prompts(spark, "b").limit(0), noted, cache, "m").count() == 0
    assert not list_objects(spark, f"file://{tmp_path}/cache/logs"), "logs go once the table has the answers"


def test_failures_are_tried_again(spark, tmp_path, noted):
    noted.broken = 2
    cache = calls.CallCache(spark, f"file://{tmp_path}/cache", tries=3, pause=0.01)
    assert calls.complete(prompts(spark, "a"), noted, cache, "m").first().answer == "A" and noted.asked() == ["a"] * 3
    waits = []
    sleep, calls.time.sleep = calls.time.sleep, waits.append
    try:
        assert calls.patient(lambda _: None, ["x", "y"], 4, 1.0) == [None, None] and waits == [1.0, 2.0, 4.0]
    finally:
        calls.time.sleep = sleep


class Dying(Noted):
    """Kills the worker at a certain prompt, once."""

    def complete(self, prompt, max_tokens=2000):
        mark = f"{self.folder}/../died"
        if len(self.asked()) >= 5 and not os.path.exists(mark):
            open(mark, "w").close()
            raise SystemExit("the worker is gone")
        return super().complete(prompt, max_tokens)


def test_a_run_that_died_half_way_is_not_paid_twice(spark, tmp_path, noted, monkeypatch):
    dying = Dying(noted.folder)
    monkeypatch.setattr(calls, "PARTS", 1)
    df = prompts(spark, *(f"p{i}" for i in range(12)))
    cache = calls.CallCache(spark, f"file://{tmp_path}/cache", tries=1)
    with pytest.raises(Exception):  # noqa: B017  a local session does not try a task again, so the run fails
        calls.complete(df, dying, cache, "m").collect()
    assert len(noted.asked()) == 5 and list_objects(spark, f"file://{tmp_path}/cache/logs") and cache.table.read().isEmpty()
    got = calls.complete(df, dying, calls.CallCache(spark, f"file://{tmp_path}/cache", tries=1), "m").orderBy("i").collect()
    assert [r.answer for r in got] == [f"P{i}" for i in range(12)]
    assert noted.asked() == sorted(f"p{i}" for i in range(12)), "each was asked once over both runs"


def test_embeddings_through_the_cache(spark, tmp_path):
    service = OfflineEmbedder(16)
    cache = calls.CallCache(spark, f"file://{tmp_path}/cache")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", None, "  ", "a b", "c" * 3000])], "i int, t string")
    want = service.embed(["a b", "blank document", "blank document", "a b", "c" * 2000])
    for _ in range(2):
        got = calls.embed(df, F.col("t"), service, cache, "m", batch=2).orderBy("i").collect()
        assert [r.embedding for r in got] == [pytest.approx(w) for w in want]
    assert cache.table.read().count() == 3


# ---- links across runs

POST = "pos long, link string"


def test_unseen_is_the_anti_join_with_all_runs(spark, tmp_path):
    seen = SeenLinks(spark, f"file://{tmp_path}")
    runs = {f"r{k}": [(i, f"https://x/{i * (k + 2)}") for i in range(400)] + [(900, None)] * (k == 1) for k in range(3)}
    new = [(i, f"https://x/{i}") for i in range(0, 3000, 7)] * 2 + [(5000 + i, f"https://y/{i}") for i in range(500)] + [(1, None), (2, "")]
    df = spark.createDataFrame(new, POST)
    assert sorted(map(tuple, seen.unseen(df).collect()), key=repr) == sorted(new, key=repr), "no run, all are new"
    old: set[str] = set()
    for run, rows in runs.items():
        seen.add(spark.createDataFrame(rows, POST), run)
        old |= {link or "" for _, link in rows}
        got = seen.unseen(df).collect()
        assert sorted(map(tuple, got), key=repr) == sorted([x for x in new if (x[1] or "") not in old], key=repr)
    assert seen.runs() == ["r0", "r1", "r2"]
    assert seen.unseen(df.limit(0)).count() == 0
    seen.add(spark.createDataFrame([], POST), "r2")
    assert seen.unseen(spark.createDataFrame([(1, "https://x/4"), (2, "https://x/1596")], POST)).count() == 1, "a run is replaced"


def test_filters_spare_most_reads(spark, tmp_path):
    seen = SeenLinks(spark, f"file://{tmp_path}")
    for run in range(3):
        seen.add(spark.range(20_000).select(F.concat(F.lit(f"https://{run}/"), "id").alias("link")), str(run))
    fresh = spark.range(20_000).select(F.concat(F.lit("https://new/"), "id").alias("link"))
    by_chance = seen.maybe(fresh).count()
    assert by_chance < 0.03 * 3 * 20_000
    known = spark.createDataFrame([("https://1/7",), ("https://1/8",)], "link string")
    hits = seen.maybe(known)
    assert {r.link for r in hits.filter("run = 1").collect()} == {"https://1/7", "https://1/8"}, "a filter never loses a link"
    size = lambda paths: sum(os.path.getsize(p[len("file:") :]) for p in paths)
    read = size(seen.stored_links(hits).inputFiles())
    every = size(list_objects(spark, f"file://{tmp_path}/links"))
    assert read < every / 20 and size(list_objects(spark, f"file://{tmp_path}/filters")) < every / 2


# ---- sessions of several writers

SID = "sid string, bk string, step string"


def test_of_two_writers_one_must_merge_anew(spark, tmp_path):
    root = f"file://{tmp_path}"
    ses.save_session(spark.createDataFrame([("s", "thing", "r1")], SID), root, "s")
    old, on = ses.read_version(spark, root, "s")
    first = ses.merged(old, spark.createDataFrame([("s", "r2")], "sid string, step string"))
    second = ses.merged(old, spark.createDataFrame([("s", "other")], "sid string, bk string"))
    assert ses.commit_session(first, root, "s", spark, on) and not ses.commit_session(second, root, "s", spark, on)
    tried = []

    def change(now):
        tried.append(now.first().step)
        if len(tried) == 1:
            ses.merge_session(spark, root, spark.createDataFrame([("s", "r3")], "sid string, step string"), "s")
        return ses.merged(now, spark.createDataFrame([("s", "other")], "sid string, bk string"))

    ses.update_session(spark, root, "s", change)
    got = ses.get_session(spark, root, "s").first()
    assert tried == ["r2", "r3"] and (got.bk, got.step) == ("other", "r3"), "neither writer's field is lost"
    ses.tidy_session(spark, root, "s")
    assert ses.get_session(spark, root, "s").first().bk == "other"


def test_documents_from_before_versions(spark, tmp_path):
    root = f"file://{tmp_path}"
    write_document(spark.createDataFrame([("s", "old", "r1")], SID), f"{root}/sessions/s/session.json")
    ses.save_session(spark.createDataFrame([("t", "new", "r1")], SID), root, "t")
    assert [tuple(r) for r in ses.sessions(spark, root).collect()] == [("t", "new", "r1"), ("s", "old", "r1")]
    ses.merge_session(spark, root, spark.createDataFrame([("s", "r2")], "sid string, step string"), "s")
    assert tuple(ses.get_session(spark, root, "s").select("bk", "step").first()) == ("old", "r2")
    ses.delete_session(spark, root, "s")
    assert ses.get_session(spark, root, "s").isEmpty()


def test_many_writers_lose_no_change(spark, tmp_path):
    root = f"file://{tmp_path}"
    ses.save_session(spark.createDataFrame([("s", "", "r1")], SID), root, "s")
    work = lambda i: ses.update_session(spark, root, "s", lambda old: old.withColumn("bk", F.concat("bk", F.lit(f"{i},"))))
    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(ses.get_session(spark, root, "s").first().bk) == sorted("0,1,2,3,")


def test_a_writer_that_died_blocks_nobody_for_long(spark, tmp_path):
    root = f"file://{tmp_path}"
    ses.save_session(spark.createDataFrame([("s", "thing", "r1")], SID), root, "s")
    folder = tmp_path / "sessions" / "s" / "versions"
    torn = folder / "000000000002.json"
    torn.write_text('{"doc')
    now = newest_version(spark, f"file://{folder}")
    assert (now.number, now.next) == (1, 2), "its number is not free while it may live"
    assert not ses.commit_session(None, root, "s", spark, now)
    os.utime(torn, (1, 1))
    assert newest_version(spark, f"file://{folder}").next == 3 and ses.get_session(spark, root, "s").first().bk == "thing"
    ses.save_session(spark.createDataFrame([("s", "next", "r2")], SID), root, "s")
    assert ses.get_session(spark, root, "s").first().bk == "next"


def test_a_table_goes_on_after_a_torn_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, v int")
    folder = tmp_path / "t" / "manifests"
    folder.mkdir(parents=True)
    (folder / "000000000000.json").write_text("{")
    os.utime(folder / "000000000000.json", (1, 1))
    table = Table.create(spark, f"file://{tmp_path}/t", df.schema)
    table.upsert(df)
    torn = folder / f"{table.manifest().version + 1:012d}.json"
    torn.write_text("")
    os.utime(torn, (1, 1))
    table.upsert(df.withColumn("v", F.lit(2)))
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]
    assert read_text(spark, f"file://{folder}/none.json") is None and json.loads(read_text(spark, f"file://{folder}/{table.manifest().version:012d}.json"))
