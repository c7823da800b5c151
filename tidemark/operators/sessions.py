"""Session documents, replaced by compare-and-set: save, read, list, delete, merge and restore."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SESSION
from ..sources.storage import Version, create_absent, delete, list_prefixes, newest_version, read_document, write_document
from .jobs import session_list
from .keywords import add_keywords

FOLDER, OLD, ATTEMPTS = "sessions", "session.json", 20


class Conflict(Exception):
    """Other writers were first each time."""


def _versions(root: str, sid: str) -> str:
    return f"{root}/{FOLDER}/{sid}/versions"


def _document(spark: SparkSession, root: str, sid: str, found: Version) -> str | None:
    """Where the session's document lies; one without versions was saved before there were any."""
    if found.body is None:
        return OLD if OLD in list_prefixes(spark, root, f"{FOLDER}/{sid}") else None
    return found.body["document"]


def read_version(spark: SparkSession, root: str, sid: str) -> tuple[DataFrame, Version]:
    """(the session's document as it is now, its version); no document gives no row."""
    found = newest_version(spark, _versions(root, sid))
    name = _document(spark, root, sid, found)
    return (read_document(spark, f"{root}/{FOLDER}/{sid}/{name}", SESSION) if name else spark.createDataFrame([], SESSION)), found


def commit_session(session: DataFrame | None, root: str, sid: str, spark: SparkSession, on: Version) -> bool:
    """Put the document in place of version `on`, None for no document; False if another writer was first.

    The document is written under a name of its own, and becomes the session's by the
    next version file, which only one writer can create.
    """
    name = None
    if session is not None:
        name = f"documents/{uuid.uuid4().hex}.json"
        write_document(session, f"{root}/{FOLDER}/{sid}/{name}")
    done = create_absent(spark, f"{_versions(root, sid)}/{on.next:012d}.json", json.dumps({"document": name}))
    if not done and name:
        delete(spark, f"{root}/{FOLDER}/{sid}/{name}")
    return done


def update_session(spark: SparkSession, root: str, sid: str, change: Callable[[DataFrame], DataFrame | None], attempts: int = ATTEMPTS, pause: float = 0.1) -> int:
    """Commit change(the document), made anew from the newest one whenever another writer was first; the new version's number."""
    for i in range(attempts):
        old, on = read_version(spark, root, sid)
        if commit_session(change(old), root, sid, spark, on):
            return on.next
        time.sleep(pause * min(i + 1, 10))
    raise Conflict(f"{root} {sid}")


def save_session(session: DataFrame, root: str, sid: str) -> None:
    """Whatever the document was, it is this one now."""
    update_session(session.sparkSession, root, sid, lambda _: session)


def merge_session(spark: SparkSession, root: str, changes: DataFrame, sid: str) -> int:
    """Replace the fields that the changes have; changes to other fields by writers at the same time are kept."""
    return update_session(spark, root, sid, lambda old: merged(old, changes))


def get_session(spark: SparkSession, root: str, sid: str) -> DataFrame:
    return read_version(spark, root, sid)[0]


def delete_session(spark: SparkSession, root: str, sid: str) -> None:
    """Only the document goes; tables made from it stay, and so does the row of its versions."""
    update_session(spark, root, sid, lambda _: None)


def tidy_session(spark: SparkSession, root: str, sid: str) -> None:
    """Remove documents that are not the session's any more; only while nobody writes."""
    kept = (newest_version(spark, _versions(root, sid)).body or {}).get("document")
    for name in list_prefixes(spark, root, f"{FOLDER}/{sid}/documents"):
        if f"documents/{name}" != kept:
            delete(spark, f"{root}/{FOLDER}/{sid}/documents/{name}")


def sessions(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """sid, bk, step of the newest sessions, blank where there is no document."""
    sids = sorted(list_prefixes(spark, root, FOLDER), reverse=True)[:limit]
    table = spark.createDataFrame([(s,) for s in sids], "sid string")
    current = [(s, _document(spark, root, s, newest_version(spark, _versions(root, s)))) for s in sids]
    paths = [f"{root}/{FOLDER}/{s}/{name}" for s, name in current if name]
    if not paths:
        return session_list(table, spark.createDataFrame([], "sid string, bk string, step string"), limit)
    lines = spark.read.text(paths, wholetext=True)
    docs = lines.select(F.from_json("value", "bk string, step string").alias("d"), F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/(documents/)?[^/]+/[^/]+$", 1).alias("sid"))
    return session_list(table, docs.select("sid", "d.*"), limit)


def with_brand(listed: DataFrame) -> DataFrame:
    return listed.filter(F.coalesce("bk", F.lit("")) != "")


def merged(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions whose fields are replaced by those of the changes that are not null."""
    new = changes.select(F.col("sid").alias("_sid"), *(F.col(c).alias(f"_{c}") for c in changes.columns if c != "sid"))
    both = old.join(new, F.col("sid") == F.col("_sid"), "full")
    fields = [F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in old.columns]
    return both.select(*fields)


def with_pending(session: DataFrame, pending: DataFrame, round_: str) -> DataFrame:
    """The session with the keywords of a round that wait for review (`_pendingKw`) and the round (`_lastRound`)."""
    kept = [c for c in session.columns if c not in ("_pendingKw", "_lastRound")]
    waiting = pending.agg(F.sort_array(F.collect_list(F.struct("id", "kw", "cat", "score", "total"))).alias("_pendingKw"))
    return session.select(*kept).join(waiting).withColumn("_lastRound", F.lit(round_))


def approve_round(sessions_: DataFrame, approved: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
    """(the session at its next step, its keywords with the approved ones)."""
    known = sessions_.select("sid", F.explode("allKw").alias("k")).select("sid", "k.*")
    return sessions_.withColumn("step", F.lit(step)), add_keywords(known, approved)


def restored(session: DataFrame) -> DataFrame:
    """A session under the client's names."""
    return session.select("sid", "bk", F.col("problemDef").alias("pd"), "step", "ages", F.col("ageRange").alias("ar"), "gens", F.col("allKw").alias("kw"))
