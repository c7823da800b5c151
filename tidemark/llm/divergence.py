"""Source divergence audit: how far the term shares of a language's sources lie apart.

Terms are coded as integers: the kept terms of a language are cut in buckets by hash and
sorted within each, so `searchsorted` codes a bucket's counts, `bincount` sums them per
source, and the codes keep the UTF-8 order of the terms, which settles ties. A bucket's
codes are cut in chunks of `CHUNK_TERMS`; a chunk holds its sources' counts as sparse
rows, which become dense vectors block by block of sources where shares are compared.

Nothing whole meets in one task: terms are summed before and after the shuffle, a language
is never a shuffle's key where it has many rows, buckets are sized by counted rows, a chunk compares two blocks of sources at a time, and only
what a language's result lists anyway, its sources, comes together in one row.

Rows: null text, lang and source are '', a repeated row counts again, texts are taken
whole, an empty table gives no rows, and further columns are not looked at. Counts are
exact up to 9e15 words a language; beyond, the job raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import coded, doc_of, join_counted, shared_dir, slices, stored, text_of, words_of

#: Documents of a language that must have a term (fixed value).
MIN_DOCS = 30
#: Shares are in billionths, counts are raised by five, and so many terms of each group are listed (fixed values).
UNIT, ADDED, TOP = 10**9, 5, 50
#: Rows of a bucket, codes of a chunk, and sources of a block.
BUCKET_ROWS, CHUNK_TERMS, BLOCK_SOURCES = 250_000, 4096, 128
#: Lower-cases A-Z and blanks other ASCII than letters; bytes of other characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, terms) as of `words_of`."""
    _, offsets, data = texts.buffers()
    if data is None:
        return words_of(texts)
    return words_of(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(data.to_pybytes().translate(NORMAL))], offset=texts.offset))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and rows that have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            offsets, words = terms_of(text_of(part.column("text")))
            codes, distinct = coded(words)
            lang, langs = coded(part.column("lang"))
            source, sources = coded(part.column("source"))
            doc, size = doc_of(offsets), max(1, len(distinct))
            once, n = np.unique(doc * size + codes, return_counts=True)
            group = (lang * len(sources) + source)[once // size]
            keys, place = np.unique(group * size + once % size, return_inverse=True)
            own = keys // size
            yield pa.record_batch([
                langs.take(pa.array(own // len(sources))), sources.take(pa.array(own % len(sources))), distinct.take(pa.array(keys % size)),
                pa.array(np.bincount(place, n, len(keys)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(keys))),
            ], names=["lang", "source", "term", "n", "docs"])

    rows = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


CHUNK = "lang string, chunk string, terms array<string>, total array<long>, sources array<string>, starts array<long>, ids array<int>, counts array<long>"


def _chunks(table: pa.Table, min_docs: int, width: int) -> pa.Table:
    """The chunks of a bucket: kept terms in order, and the counts of each source as a sparse row of (id, count)."""
    table = table.combine_chunks()
    terms = table.column("term").combine_chunks()
    code, distinct = coded(terms)
    docs = np.bincount(code, table.column("docs").to_numpy(), len(distinct))
    own = np.array([x.encode() for x in distinct.to_pylist()], object)
    kept = np.sort(own[docs >= min_docs])
    names = ["lang", "chunk", "terms", "total", "sources", "starts", "ids", "counts"]
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("terms", pa.list_(pa.string())), ("total", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    if not len(kept):
        return schema.empty_table()
    place = np.minimum(np.searchsorted(kept, own), len(kept) - 1)
    at = np.where(kept[place] == own, place, -1)[code]
    some = np.flatnonzero(at >= 0)
    at, n = at[some], table.column("n").to_numpy()[some]
    source, sources = coded(table.column("source").combine_chunks().take(pa.array(some)))
    order = np.lexsort((at, source, at // width))
    at, n, source = at[order], n[order], source[order]
    total = np.bincount(at, n, len(kept)).astype(np.int64)
    out = {x: [] for x in names}
    for first in range(0, len(kept), width):
        lo, hi = np.searchsorted(at // width, [first // width, first // width + 1])
        here, starts = np.unique(source[lo:hi], return_index=True)
        row = (table.column("lang")[0].as_py(), f"{table.column('bucket')[0].as_py()}-{first}", [x.decode() for x in kept[first : first + width]], total[first : first + width], sources.take(pa.array(here)).to_pylist(), [*starts.tolist(), hi - lo], (at[lo:hi] - first).astype(np.int32), n[lo:hi])
        for x, value in zip(names, row, strict=True):
            out[x].append(value)
    return pa.table([pa.array(out[x], schema.field(x).type) for x in names], schema=schema)


def shares(count: np.ndarray, over: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / over), exactly: nine decimal places in three steps of a thousand."""
    if over.size and int(over.max()) >= 2**53:
        raise ValueError("more than 9e15 words in one language")
    over = np.maximum(over, 1)  # without terms there is nothing to share
    out, rest = count // over, count % over
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // over, rest % over
    return out + 1


class _Chunk:
    """A chunk as it is read, with its language's sources and sums."""

    def __init__(self, row: dict) -> None:
        self.terms, self.names = row["terms"], row["all_sources"]
        self.sums, self.v = np.array(row["sums"], np.int64), row["v"]
        self.total = np.array(row["total"], np.int64)
        place = {x: i for i, x in enumerate(self.names)}
        self.row_of = np.array([place[x] for x in row["sources"]], np.int64)
        self.starts, self.ids, self.counts = (np.array(row[x], np.int64) for x in ("starts", "ids", "counts"))

    def block(self, k: int, size: int) -> tuple[int, np.ndarray]:
        """(first source, (sources, terms) shares) of a block of sources."""
        lo, hi = k * size, min((k + 1) * size, len(self.names))
        counts = np.zeros((hi - lo, len(self.terms)), np.int64)
        for i in np.flatnonzero((self.row_of >= lo) & (self.row_of < hi)).tolist():
            own = slice(self.starts[i], self.starts[i + 1])
            counts[self.row_of[i] - lo, self.ids[own]] = self.counts[own]
        return lo, shares(counts + ADDED, (self.sums[lo:hi] + ADDED * self.v)[:, None])


def _pair_sums(table: pa.Table, block: int) -> pa.Table:
    """Sums of |p - q| over a chunk's terms for each pair of sources of two blocks."""
    row = table.to_pylist()[0]
    chunk, same = _Chunk(row), row["a"] == row["b"]
    n_a, a = chunk.block(row["a"], block)
    n_b, b = (n_a, a) if same else chunk.block(row["b"], block)
    i, j, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(a)):
        first = k + 1 if same else 0
        value.append(np.abs(b[first:] - a[k]).sum(1))
        i.append(np.full(len(value[-1]), n_a + k))
        j.append(n_b + np.arange(first, len(b)))
    names = pa.array(chunk.names, pa.string())
    i, j, value = (np.concatenate(x) for x in (i, j, value))
    return pa.table([pa.array([row["lang"]] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(value)], names=["lang", "x", "y", "value"])


def _top_terms(table: pa.Table) -> pa.Table:
    """The first `TOP` terms of each source within a chunk, by value, then by code, which is UTF-8 order."""
    row = table.to_pylist()[0]
    chunk = _Chunk(row)
    q = shares(chunk.total + ADDED, np.array([int(chunk.sums.sum()) + ADDED * chunk.v]))
    source, item, value = [], [], []
    for i, number in enumerate(chunk.row_of.tolist()):
        own = slice(chunk.starts[i], chunk.starts[i + 1])
        ids = chunk.ids[own]
        f = shares(chunk.counts[own] + ADDED, chunk.sums[number : number + 1] + ADDED * chunk.v) - q[ids]
        ids, f = ids[f > 0], f[f > 0]
        best = np.lexsort((ids, -f))[:TOP]
        source += [chunk.names[number]] * len(best)
        item += [chunk.terms[x] for x in ids[best].tolist()]
        value += f[best].tolist()
    return pa.table([pa.array([row["lang"]] * len(item), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, bucket_rows: int = BUCKET_ROWS, width: int = CHUNK_TERMS, block: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank.

    Each language keeps the terms in at least `min_docs` of its rows. p of a term in a
    group is 1 + floor(1e9 (count + 5) / (N + 5 V)). Part `pair` lists for each (lang,
    source) every other source of the language with the sum of |p - q| over kept terms;
    part `term` lists the 50 terms that the group has and whose p exceeds the language's
    most. Ranks go by value, then by the item's UTF-8 order. Sizes of buckets, chunks and
    blocks only plan the work.
    """
    spark = docs.sparkSession
    at = shared_dir(spark, "divergence")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(blank("text"), blank("lang"), blank("source"))
    counts = stored(term_counts(rows), f"{at}/counts")
    parts = counts.groupBy("lang").agg(F.count("*").alias("n"), F.ceil(F.count("*") / bucket_rows).cast("int").alias("parts"))
    keyed = join_counted(counts.withColumnRenamed("n", "times"), parts, ["lang"]).withColumnsRenamed({"n": "rows", "times": "n"})
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")).drop("parts", "rows")
    chunks = stored(keyed.groupBy("lang", "bucket").applyInArrow(lambda t: _chunks(t, min_docs, width), CHUNK), f"{at}/chunks")
    own = chunks.select("lang", F.explode(F.arrays_zip("sources", F.slice("starts", 1, F.size("sources")).alias("lo"), F.slice("starts", 2, F.size("sources")).alias("hi"))).alias("s"), "counts")
    sums = own.select("lang", F.col("s.sources").alias("source"), F.aggregate(F.slice("counts", F.col("s.lo").cast("int") + 1, (F.col("s.hi") - F.col("s.lo")).cast("int")), F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    sums = sums.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("v"), F.count("*").alias("chunks"))
    listed = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s")  # as many as each of them has rows in the result
    langs = groups.groupBy("lang").agg(listed).join(sizes, "lang", "left")
    langs = stored(langs.select("lang", F.col("s.source").alias("all_sources"), F.col("s.n").alias("sums"), F.coalesce("v", F.lit(0)).cast("long").alias("v"), (F.coalesce("chunks", F.lit(0)) + 1).alias("n")), f"{at}/langs")
    none = F.array()
    empty = langs.select("lang", F.lit("").alias("chunk"), none.cast("array<string>").alias("terms"), none.cast("array<long>").alias("total"), none.cast("array<string>").alias("sources"), F.array(F.lit(0).cast("long")).alias("starts"), none.cast("array<int>").alias("ids"), none.cast("array<long>").alias("counts"))
    blocks = F.ceil(F.size("all_sources") / block).cast("int")
    whole = join_counted(chunks.union(empty), langs, ["lang"])
    tasks = whole.withColumn("a", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("b", F.explode(F.sequence("a", blocks - 1)))
    half = tasks.groupBy("lang", "chunk", "a", "b").applyInArrow(lambda t: _pair_sums(t, block), "lang string, x string, y string, value long").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    half = stored(half, f"{at}/pairs")
    pairs = half.select("lang", F.col("x").alias("source"), F.lit("pair").alias("part"), F.col("y").alias("item"), "value").union(half.select("lang", F.col("y"), F.lit("pair"), F.col("x"), "value"))
    terms = whole.groupBy("lang", "chunk").applyInArrow(_top_terms, "lang string, source string, item string, value long")
    every = pairs.union(terms.select("lang", "source", F.lit("term"), "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return every.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


#: The same rows; DuckDB compares strings by their UTF-8 bytes.
ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM dense JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
    FROM (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total, v FROM dense JOIN v USING (lang)) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 50"""
