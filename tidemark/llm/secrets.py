"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates in each text. The value of a candidate is hashed, and the
corpus tells how many repositories and owners hold the hash, where equal texts count once,
as the first of them: a value that several owners or many repositories hold is a copied
example, any other looks live. Spans of the base kinds always stay; those of the other
kinds are added where their value looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, shared_dir, stored, text_of

#: Base kinds in their order, with the group whose length counts and its least length (fixed values).
BASE = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: The same matches for hex, found faster: a run of 24 or more is a maximal run.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Further kinds, only kept where their value looks live.
MORE = {
    "bearer": (re.compile(r"\bBearer\x20+([A-Za-z0-9._~+/=-]{16,})"), 1),
    "forge": (re.compile(r"\b(?:gh[opsru]_|glpat-|xox[abprs]-)[A-Za-z0-9_-]{16,}"), 0),
    "jwt": (re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    "url": (re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/:@]{6,128})@"), 1),
}
#: Strings of which a text with a match of the kind holds one.
HINTS = {"access": ("AKIA",), "bearer": ("Bearer ",), "forge": ("gho_", "ghp_", "ghs_", "ghr_", "ghu_", "glpat-", "xox"), "jwt": ("eyJ",), "url": ("://",)}
ORDER = {k: i for i, k in enumerate([*BASE, *MORE])}
#: Repositories of different texts that may hold a value of one owner before it is a copied example (fixed value).
MAX_REPOS = 10
FOUND = "row long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, base string, same binary, candidates array<struct<kind:string,start:long,end:long,value:binary>>"


def scan(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, kind number, end, hash of the value) of every candidate, in order."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        if kind in HINTS and not any(h in text for h in HINTS[kind]):
            continue
        for m in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), ORDER[kind], m.end(), xxhash.xxh3_128_digest(m[group].encode())))
    for kind, (pattern, group) in MORE.items():
        if any(h in text for h in HINTS[kind]):
            found += [(m.start(), ORDER[kind], m.end(), xxhash.xxh3_128_digest(m[group].encode())) for m in pattern.finditer(text)]
    return sorted(found)


def joined(found: list[tuple]) -> str:
    kinds = [*ORDER]
    return ",".join(f"{kinds[k]}:{start}:{end}" for start, k, end, *_ in found)


def find_candidates(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row for each document, with a number of its own, its candidates and, where it has some, the hash of its text (FOUND).

    Write the table before it is used twice, since numbers may differ between runs.
    """
    kinds = [*ORDER]
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, bases, same, candidates = [], [], [], [], []
            for text in text_of(batch.column("text")):
                text = text.as_py()
                found = scan(text)
                base = [x for x in found if x[1] < len(BASE)]
                counts.append([sum(x[1] == i for x in base) for i in range(len(BASE))])
                bases.append(joined(base))
                shas.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                same.append(xxhash.xxh3_128_digest(text.encode()) if found else None)
                candidates.append([{"kind": kinds[k], "start": s, "end": e, "value": v} for s, k, e, v in found])
            yield pa.record_batch([*batch.columns[:4], *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(shas, pa.string()), pa.array(bases, pa.string()), pa.array(same, pa.binary()), pa.array(candidates, pa.list_(struct))], names=["row", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "base", "same", "candidates"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), "text").mapInArrow(run, FOUND)


def ownership(found: DataFrame, max_owners: int = 1, max_repos: int = MAX_REPOS) -> DataFrame:
    """value, n (occurrences), n_repos, n_owners, live: of each distinct candidate value.

    Equal texts are one place, of the smallest doc_id's repository and owner, so copies of
    a document make no example. Distinct (value, text), then (value, owner) and (value,
    repository) pairs are made first, with partial aggregation before the shuffle, so that
    a value in a third of all texts is no hot key.
    """
    each = found.select("same", F.struct("doc_id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")).alias("place"), F.explode("candidates.value").alias("value"))
    pairs = each.groupBy("value", "same").agg(F.min("place").alias("first"), F.count("*").alias("n")).select("value", "n", "first.repo", "first.owner")
    owners = pairs.groupBy("value", "owner").agg(F.sum("n").alias("n")).groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n"))
    repos = pairs.select("value", "repo").distinct().groupBy("value").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def find_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = 1, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example; one row for each row.

    `spans` are kind:start:end in code points, ordered by start, then kind. Null text is
    empty; null owners and repositories count as one owner and one repository; rows with
    one doc_id are rows of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = stored(find_candidates(docs, repo, owner), shared_dir(spark, "candidates"))
    each = found.filter(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    judged = join_counted(each, ownership(found, max_owners, max_repos).select("value", "n", "live"), ["value"])
    rank = F.element_at(F.create_map(*(F.lit(x) for k, v in ORDER.items() for x in (k, v))), F.col("kind"))
    order = F.struct("start", rank.alias("rank"), "end", "kind")
    stays = F.col("live") | F.col("kind").isin([*BASE])
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.when(stays, order))).alias("kept"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    text = F.array_join(F.transform("kept", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    per_row = per_row.select("row", text.alias("all_spans"), "n_live", "n_example")
    return found.join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("all_spans", "base").alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example")
    )


__all__ = ["find_candidates", "find_secrets", "ownership", "scan"]
