"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Lines are hashed. A rolling hash over two neighbouring line hashes proposes an end after
every second line on average, and so does a line that equals the one before; of ends
proposed one after the other every second one holds, so a chunk has two lines at least
(but the last, or the first) and ends shift with the text. Chunks of two or more lines
that occur anywhere before are removed once their bytes were compared with the first
occurrence. First means the smallest doc_id, then the smallest place.

A repeated passage seldom begins and ends with a chunk. So from each removed chunk the
match goes on line by line in both directions, as far as the lines are those around the
first occurrence, through the neighbouring chunk where that is not removed itself; these
lines are removed too. Of every removed line an equal one stays at an earlier place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, shared_dir, stored

#: A rolling hash whose first hexadecimal digit is below this proposes an end (fixed value).
BELOW = "8"
#: Occurrences that one part of a frequent key may have.
SPREAD = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, wherever the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_chunks(docs: DataFrame, *rest: str) -> DataFrame:
    """The columns `rest`, and `chunks`: the texts of each text's content-defined chunks in order."""

    def proposed(hashes: Column) -> Column:
        before = F.array_prepend(F.slice(hashes, 1, F.size(hashes) - 1), "")
        return F.zip_with(before, hashes, lambda a, b: (a == b) | (F.substring(F.md5(F.concat(a, b)), 1, 1) < BELOW))

    def cuts(ends: Column) -> Column:
        """Numbers of lines up to each end that holds: the odd ones of each run of proposed ends, and the last line."""
        last = F.size(ends) - 1
        rest_ = F.filter(F.transform(ends, lambda p, i: F.when(~p, i)), lambda i: i.isNotNull())
        runs = F.zip_with(F.array_prepend(rest_, F.lit(-1)), F.array_append(rest_, last + 1), lambda a, b: F.when(b - a > 1, F.sequence(a + 2, b, F.lit(2))).otherwise(F.array().cast("array<int>")))
        return F.array_union(F.filter(F.flatten(runs), lambda e: e <= last + 1), F.array(last + 1))

    def texts(lines: Column) -> Column:
        each = lambda ends: F.zip_with(F.array_prepend(F.slice(ends, 1, F.size(ends) - 1), F.lit(0)), ends, lambda a, b: F.array_join(F.slice(lines, a + 1, b - a), "\n"))
        return let(let(let(F.transform(lines, F.md5), proposed), cuts), each)

    return docs.select(*rest, let(F.split(F.coalesce("text", F.lit("")), "\n", -1), texts).alias("chunks"))


def salt(parts: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "own"), parts).cast("int")


def salts(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))


def n_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def ranks(places: Column, size: Column) -> Column:
    """For each place below `size` its number in the ascending `places`, or -1; in linear time."""

    def dealt(edges: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.array_prepend(F.array_repeat(F.lit(-1), F.get(edges, k + 1) - p - 1), k))
        return F.flatten(F.array_prepend(gaps, F.array_repeat(F.lit(-1), F.get(edges, F.lit(0)))))

    return let(F.array_append(places, size), dealt)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def n_common(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from their start; 0 where one is null."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.coalesce(F.when(unlike == 0, F.size(a)).otherwise(unlike - 1), F.lit(0))


def is_first(doc_id: Column, place: Column, first: Column) -> Column:
    return doc_id.eqNullSafe(first["doc_id"]) & (place == first["place"])


def with_neighbours(chunks: Column, flagged: Column) -> Column:
    """Each flagged place with its chunk, the chunks before and after it, and whether these stay."""
    first = lambda f: is_first(F.col("doc_id"), f["place"], f["first"])

    def each(rank: Column) -> Column:
        near = lambda i: F.struct(F.get(chunks, i).alias("chunk"), F.when(F.get(rank, i) >= 0, first(F.get(flagged, F.get(rank, i)))).otherwise(F.lit(True)).alias("stays"))
        return F.transform(flagged, lambda f: F.struct(f.alias("f"), F.get(chunks, f["place"]).alias("chunk"), near(f["place"] - 1).alias("before"), near(f["place"] + 1).alias("after")))

    return let(ranks(F.transform(flagged, lambda f: f["place"]), F.size(chunks)), each)


def without(chunks: Column, gone: Column) -> Column:
    """What is left of the chunks; `gone` has places ascending, and the lines that go before and after each."""

    def trimmed(chunk: Column, head: Column, tail: Column) -> Column:
        some = F.array_join(F.slice(lines_of(chunk), head + 1, n_lines(chunk) - head - tail), "\n")
        return F.when(head + tail == 0, chunk).when(head + tail < n_lines(chunk), some)

    def each(rank: Column) -> Column:
        beside = lambda i, side: F.coalesce(F.get(gone, F.get(rank, i))[side], F.lit(0))
        left = F.transform(chunks, lambda c, i: F.when(F.get(rank, i) < 0, trimmed(c, beside(i - 1, "after"), beside(i + 1, "before"))))
        return F.filter(left, lambda c: c.isNotNull())

    return let(ranks(F.transform(gone, lambda g: g["place"]), F.size(chunks)), each)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), kept_text; one row for each row of `docs`.

    Null text is empty, which is one empty line. Rows of one doc_id and one text are one
    document's occurrences: a chunk at the first place in any of them stays in each, and of
    their lines around it those of the smallest chunks are compared. A null doc_id sorts
    first. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("own"))
    each = line_chunks(rows, "doc_id", "own").select("doc_id", "own", F.posexplode("chunks").alias("place", "chunk"))
    multi = each.filter(F.contains("chunk", F.lit("\n")))
    keys = stored(multi.select("doc_id", "own", "place", F.xxhash64("chunk").alias("h1"), F.xxhash64(F.lit(1), "chunk").alias("h2")), shared_dir(docs.sparkSession, "lines"))
    repeated = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first")).filter("n > 1")
    found = join_counted(keys, repeated, ["h1", "h2"])
    flagged = found.groupBy("doc_id", "own").agg(F.array_sort(F.collect_set(F.struct("place", "h1", "h2", "n", "first"))).alias("flagged"))
    flagged = flagged.select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), "flagged")
    of = (rows["own"] == flagged["_own"]) & rows["doc_id"].eqNullSafe(flagged["_id"])
    marked = line_chunks(rows.join(flagged, of), "doc_id", "own", "flagged")
    seen = marked.select("doc_id", "own", F.explode(with_neighbours(F.col("chunks"), F.col("flagged"))).alias("f")).select("doc_id", "own", "f.f.*", "f.chunk", "f.before", "f.after")
    seen = seen.withColumn("parts", 1 + F.floor(F.col("n") / SPREAD))
    stays = is_first(F.col("doc_id"), F.col("place"), F.col("first"))
    where = F.struct("chunk", F.col("before.chunk").alias("before"), F.col("after.chunk").alias("after"))
    firsts = seen.filter(stays).groupBy("h1", "h2", "parts").agg(F.min(where).alias("first_at")).withColumn("salt", salts(F.col("parts"))).drop("parts")
    own_side = lambda side: F.when(F.col(f"{side}.stays"), F.col(f"{side}.chunk")).alias(side)
    copies = seen.filter(~stays).select("doc_id", "own", "place", "h1", "h2", "chunk", own_side("before"), own_side("after"), salt(F.col("parts")).alias("salt"))
    copies = copies.join(firsts, ["h1", "h2", "salt"]).filter("chunk = first_at.chunk")
    back = n_common(F.reverse(lines_of(F.col("before"))), F.reverse(lines_of(F.col("first_at.before")))).alias("before")
    ahead = n_common(lines_of(F.col("after")), lines_of(F.col("first_at.after"))).alias("after")
    gone = copies.select("doc_id", "own", F.struct("place", back, ahead).alias("gone")).groupBy("doc_id", "own").agg(F.array_sort(F.collect_set("gone")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"), "gone")
    joined = rows.join(gone, (rows["own"] == gone["_own"]) & rows["doc_id"].eqNullSafe(gone["_id"]), "left")
    out = line_chunks(joined, "doc_id", F.coalesce("gone", F.array().cast("array<struct<place:int,before:int,after:int>>")).alias("gone"))
    out = out.select("doc_id", "chunks", without(F.col("chunks"), F.col("gone")).alias("kept"))
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + n_lines(x))
    total = out.select("doc_id", count("chunks").alias("n_lines"), count("kept").alias("n_kept"), F.array_join("kept", "\n").alias("kept_text"))
    return total.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_removed"), "kept_text")


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), h AS (
  SELECT *, md5(line) AS m, lag(md5(line)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM l
), q AS (
  SELECT *, coalesce(b = m, false) OR substr(md5(coalesce(b, '') || m), 1, 1) < '8' AS proposed FROM h
), r AS (
  SELECT *, proposed AND (i - coalesce(max(CASE WHEN NOT proposed THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS cut FROM q
), c AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM r
), g AS (
  SELECT doc_id, k, count(*) > 1 AS multi, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, k
), f AS (
  SELECT *, multi AND row_number() OVER o > 1 AS gone,
         first_value(doc_id) OVER o AS first_id, first_value(k) OVER o AS first_k
  FROM g WINDOW o AS (PARTITION BY chunk ORDER BY doc_id NULLS FIRST, k)
), n AS (
  SELECT c.doc_id, c.k, c.i, c.line, f.gone, row_number() OVER (PARTITION BY c.doc_id, c.k ORDER BY c.i) AS p,
         row_number() OVER (PARTITION BY c.doc_id, c.k ORDER BY c.i DESC) AS q
  FROM c JOIN f ON c.doc_id IS NOT DISTINCT FROM f.doc_id AND c.k = f.k
), back AS (
  SELECT f.doc_id, f.k - 1 AS k, coalesce(min(CASE WHEN y.line IS DISTINCT FROM x.line THEN x.q END) - 1, count(*)) AS lines
  FROM f JOIN n x ON x.doc_id IS NOT DISTINCT FROM f.doc_id AND x.k = f.k - 1 AND NOT x.gone
  LEFT JOIN n y ON y.doc_id IS NOT DISTINCT FROM f.first_id AND y.k = f.first_k - 1 AND y.q = x.q
  WHERE f.gone GROUP BY f.doc_id, f.k
), ahead AS (
  SELECT f.doc_id, f.k + 1 AS k, coalesce(min(CASE WHEN y.line IS DISTINCT FROM x.line THEN x.p END) - 1, count(*)) AS lines
  FROM f JOIN n x ON x.doc_id IS NOT DISTINCT FROM f.doc_id AND x.k = f.k + 1 AND NOT x.gone
  LEFT JOIN n y ON y.doc_id IS NOT DISTINCT FROM f.first_id AND y.k = f.first_k + 1 AND y.p = x.p
  WHERE f.gone GROUP BY f.doc_id, f.k
), e AS (
  SELECT n.doc_id, n.i, n.line, n.gone OR n.q <= coalesce(b.lines, 0) OR n.p <= coalesce(a.lines, 0) AS gone
  FROM n LEFT JOIN back b ON b.doc_id IS NOT DISTINCT FROM n.doc_id AND b.k = n.k
  LEFT JOIN ahead a ON a.doc_id IS NOT DISTINCT FROM n.doc_id AND a.k = n.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM e GROUP BY doc_id
"""
