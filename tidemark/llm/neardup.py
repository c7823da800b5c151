"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed word 5-grams; those with equal sets are one text. Texts
that agree in one of 32 bands of 4 MinHash values are candidates: at a similarity of 0.8
a pair is missed with a probability of 5e-8. A candidate pair's MinHash values are
compared 16 at a time and it is dropped as soon as the posterior probability (uniform
prior) that its similarity reaches the threshold falls below a tolerance.

What remains spans components, in which the exact similarity of all pairs is taken.
Components beyond a block of texts are cut in blocks, and each pair of blocks is a task
of its own, which returns only each text's number of links and the root of its local
tree, never the pairs. Texts in a crowded band bucket are not paired there but tied to
the bucket's smallest text, and so meet in a component, blockwise, with the same test.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import BinaryType, StructField, StructType

from .common import MIX_A, doc_of, drop_dir, free_name, join_counted, mixed, shared_dir, slices, stored, text_of
from .components import connected_components
from .quality import Words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
#: A pair is dropped when its posterior probability of reaching the threshold is lower.
TOLERANCE = 1e-9
#: Texts of a band bucket that are paired there; those of a larger one meet blockwise.
CROWD = 64
#: Texts of a block.
BLOCK = 256
#: Bits of the bitmap that finds texts again.
MARKS = 1 << 25
_seeds = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * MIX_A)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """The fewest equal values among the first 16, 32, ... with which a pair stays.

    With m of n values equal the similarity's posterior is Beta(m + 1, n - m + 1); it
    reaches t with the probability that at most m of n + 1 tosses of chance t succeed.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word 5-grams; of a shorter text, of all its words."""
    w = Words.of(texts)
    h, n = w.hash[w.codes], np.diff(w.offsets)
    with np.errstate(over="ignore"):
        gram, inside = h, np.zeros(0, np.int64)
        if len(h) >= SHINGLE:
            gram = h[: len(h) - SHINGLE + 1]
            for j in range(1, SHINGLE):
                gram = mixed(gram * MIX_A + h[j : len(h) - SHINGLE + 1 + j])
            doc = doc_of(w.offsets)
            inside = np.flatnonzero(doc[: len(gram)] == doc[SHINGLE - 1 :])
            gram = gram[inside]
        cuts = np.searchsorted(inside, w.offsets)
        out = []
        for i in range(len(n)):
            if 0 < n[i] < SHINGLE:
                short = np.uint64(0)
                for x in h[w.offsets[i] : w.offsets[i + 1]]:
                    short = mixed(np.array([short * MIX_A + x]))[0]
                out.append(np.array([short]))
            else:
                out.append(np.unique(gram[cuts[i] : cuts[i + 1]]))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 16 bits of each."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 1024):
        with np.errstate(over="ignore"):
            x = (grams[at : at + 1024, None] ^ _seeds) * MIX_A
            least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, bands) 64-bit keys of each signature's bands."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for r in range(ROWS):
            key = mixed(key * MIX_A + parts[..., r])
    return key.view(np.int64)


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (rows of a and b) no step drops."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        at = slice(k * STEP, (k + 1) * STEP)
        equal = equal[: len(alive)] + (a[alive, at] == b[alive, at]).sum(1)
        keep = equal >= m
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(i) < 1500:
        return np.fromiter((len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, column = rows[times[column] > 1], column[times[column] > 1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width, top = 4096, int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        if hi > lo:
            used, place = np.unique(column[lo:hi], return_inverse=True)
            dense = np.zeros((len(sets), len(used)), np.float32)
            dense[rows[lo:hi], place] = 1
            total += dense @ dense.T
    return total[i, j].astype(np.int64)


def links(sets: list[np.ndarray], signatures: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, least: list[int]) -> np.ndarray:
    """Which of the pairs (i, j) reach the threshold."""
    sizes = np.array([len(s) for s in sets])
    near = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
    at = np.flatnonzero(near)
    at = np.concatenate([p[surviving(signatures[i[p]], signatures[j[p]], least)] for p in np.array_split(at, max(1, len(at) // 65536))])
    out = np.zeros(len(i), bool)
    if len(at):
        both = overlaps(sets, i[at], j[at])
        out[at] = both >= threshold * (sizes[i[at]] + sizes[j[at]] - both)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number of each one's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return root


SKETCH = "doc_id long, place long, same binary, n_grams long, signature binary"
ITEM = "rep long, links long, root long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and `place`, a hash of the text; both find a row again, whether or not its id is null or repeated."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("place"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, place, digest of the set, its size and MinHash values, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(text_of(part.column("text")))
            yield pa.record_batch([part.column("doc_id"), part.column("place"), pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "place", "same", "n_grams", "signature"])

    return keyed(docs).mapInArrow(run, SKETCH)


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _bands(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES))
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], names=["key", "rep"])

    return texts.select("rep", "signature").mapInArrow(run, "key long, rep long")


def _pruned(pairs: DataFrame, least: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array(surviving(x, y, least)))

    return pairs.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(text_of(part.column("text")))
            yield pa.record_batch([part.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["rep", "grams", "signature"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, grams binary, signature binary")


def _verified(items: DataFrame, threshold: float, least: list[int]) -> DataFrame:
    """ITEM rows of each task: a bin of whole components, or a pair of blocks of one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, comp, block, copies = (table.column(c).to_numpy() for c in ("rep", "comp", "block", "copies"))
        order = np.lexsort((rep, comp))
        rep, comp, block, copies = rep[order], comp[order], block[order], copies[order]
        grams, sig = table.column("grams").to_pylist(), table.column("signature").to_pylist()
        sets = [np.frombuffer(grams[k], np.uint64) for k in order]
        signatures = np.frombuffer(b"".join(sig[k] for k in order), np.uint16).reshape(-1, HASHES)
        cuts = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
        count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i, j = np.triu_indices(hi - lo, 1)
            if table.column("cross")[0].as_py():
                keep = block[lo + i] != block[lo + j]
                i, j = i[keep], j[keep]
            ok = links(sets[lo:hi], signatures[lo:hi], i, j, threshold, least)
            i, j = i[ok], j[ok]
            count[lo:hi] = np.bincount(i, copies[lo + j], hi - lo) + np.bincount(j, copies[lo + i], hi - lo)
            root[lo:hi] = lo + _roots(hi - lo, i, j)
        return pa.table([pa.array(rep), pa.array(count), pa.array(rep[root])], names=["rep", "links", "root"])

    return items.groupBy("task").applyInArrow(run, ITEM)


def parted(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the rows that can have a key of `wanted`, the others), so that a join need not shuffle the others.

    A bitmap of `MARKS` bits, as words of 64, is sent to all tasks; its size has that bound
    whatever `wanted` holds, and keys that share a bit only pass more rows on.
    """
    word, bits = (free_name(n, rows.columns) for n in ("_word", "_bits"))
    slot = F.shiftright(F.pmod(F.xxhash64(*keys), F.lit(MARKS)), 6).alias(word)
    bit = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({', '.join(keys)}), 64L) AS int))")
    marks = wanted.select(slot, bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    marked = rows.withColumn(word, slot).join(F.broadcast(marks), word, "left")
    can = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    first, rest = (marked.filter(x).select(*[f"`{c}`" for c in rows.columns]) for x in (can, ~can))
    return first, rest


def classes(docs: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD, block: int = BLOCK, path: str | None = None) -> DataFrame:
    """doc_id, same, n_grams, class (a number of its own for each class of texts with words), class_id, n_links; one row for each row.

    A text is a set of grams, numbered when it is first written; documents, whose ids may
    be null or repeated, only name it. Intermediate tables lie under `path`.
    """
    spark = docs.sparkSession
    at = path or shared_dir(spark, "neardup")
    least = least_matches(threshold)
    every = stored(sketches(docs), f"{at}/sketches")
    full = every.filter("n_grams > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    texts = full.groupBy("same").agg(first, F.count("*").alias("copies"), F.first("signature").alias("signature"))
    texts = stored(texts.withColumn("rep", F.monotonically_increasing_id()), f"{at}/texts")
    bands = stored(_bands(texts), f"{at}/bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first")).filter("n > 1")
    kept = stored(bands.join(shared, "key"), f"{at}/kept")
    few = kept.filter(F.col("n") <= crowd)
    pairs = few.select("key", F.col("rep").alias("a")).join(few.select("key", F.col("rep").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    sig = texts.select("rep", "signature")
    pairs = pairs.join(sig.toDF("a", "x"), "a").join(sig.toDF("b", "y"), "b")
    crowded = kept.filter((F.col("n") > crowd) & (F.col("rep") != F.col("first"))).select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    components = connected_components(_pruned(pairs, least).union(crowded), f"{at}/components")
    members = components.select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    members = members.union(members.select("comp", "comp").distinct().toDF("rep", "comp")).join(texts.select("rep", "copies", "first"), "rep")
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = stored(members.join(sizes, "comp"), f"{at}/members")
    bins = max(1, members.filter("blocks = 1").count() // (2 * block))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = members.drop("first").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task = F.when(F.col("blocks") == 1, F.concat(F.lit("bin-"), F.pmod(F.xxhash64("comp"), F.lit(bins)))).otherwise(F.concat_ws("-", "comp", low, high))
    placed = placed.withColumn("task", task).withColumn("cross", (F.col("blocks") > 1) & (low != high))
    id_ = F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("none")).alias("id")
    wanted = members.select("rep", F.struct(F.coalesce("first.doc_id", F.lit(0)).alias("i"), F.col("first.none").alias("none")).alias("id"), "first.place")
    rows = parted(keyed(docs).select(id_, "place", "text"), wanted, ["id", "place"])[0].join(wanted, ["id", "place"]).dropDuplicates(["id", "place"])
    sets = stored(_sets(rows), f"{at}/sets")
    found = stored(_verified(placed.join(sets, "rep"), threshold, least), f"{at}/verified")
    local = found.groupBy("rep").agg(F.sum("links").alias("links"))
    trees = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), f"{at}/trees").toDF("rep", "class")
    trees = stored(trees.union(trees.select("class", "class").distinct().toDF("rep", "class")).join(texts.select("rep", F.col("first.doc_id").alias("first")), "rep"), f"{at}/classes")
    named = join_counted(trees.select("rep", "class"), trees.groupBy("class").agg(F.min("first").alias("least"), F.count("*").alias("n")), ["class"]).drop("n")
    texts = texts.select("same", "rep", "copies", F.col("first.doc_id").alias("first")).join(local, "rep", "left").join(named, "rep", "left")
    texts = texts.select("same", F.coalesce("class", "rep").alias("class"), F.when(F.col("class").isNull(), F.col("first")).otherwise(F.col("least")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    empty = every.filter("n_grams = 0").select("doc_id", "same", "n_grams", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.select("doc_id", "same", "n_grams").join(texts, "same").select("doc_id", "same", "n_grams", "class", "class_id", "n_links").union(empty)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links; one row for each row.

    Two documents are linked when the Jaccard similarity of their sets of word 5-grams
    is `threshold` or more. n_links counts the other documents linked to this one,
    copies included; class_id is the smallest doc_id that links lead to, null where they
    lead to none that is not null. Rows with a null id are documents like others, and so
    are rows that share an id but not the text. A text without words, null included, has
    no links and is a class of its own; a text of one to four words is one gram. A
    repeated row counts as a copy. An empty table gives no rows.
    """
    return classes(docs, threshold, crowd, block).select("doc_id", "class_id", "n_links")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class stays, with the smallest doc_id; one without an id only where the whole class has none.

    Rows that share an id but not the text stay, unless they are near copies of others.
    Texts without words stay, once for each id and text.
    """
    spark = docs.sparkSession
    at = shared_dir(spark, "neardup")
    found = stored(classes(docs, threshold, path=at), shared_dir(spark, "classes"))
    drop_dir(spark, at)
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL")
    ids = stored(ids, shared_dir(spark, "odd"))
    gone = found.filter("doc_id <> class_id").select(F.col("doc_id").alias("id")).distinct()
    key = free_name("_id", docs.columns)
    docs, sure = (x.drop(key) for x in parted(docs.withColumn(key, F.col("doc_id").cast("long")), gone.union(ids.select("id")).toDF(key), [key]))
    own = docs["doc_id"].cast("long")
    left = sure.unionByName(docs.join(gone, own == gone["id"], "left_anti"))
    if ids.isEmpty():
        return left
    odd = docs.join(ids, own.eqNullSafe(ids["id"]), "left_semi")
    name = free_name("same", docs.columns)
    names = [*docs.columns, name]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(text_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([digest(s) if len(s) else None for s in sets], pa.binary())], names=names)

    # of each class the rows with its smallest id, and of these the text that comes first
    best = found.filter("class IS NOT NULL AND doc_id <=> class_id").groupBy("class").agg(F.min("same").alias("same")).select(F.col("same").alias("_same"))
    best = best.join(found.filter("class IS NOT NULL").select(F.col("same").alias("_same"), F.col("class_id").alias("_id")).distinct(), "_same")
    odd = odd.mapInArrow(digests, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
    firsts = odd.join(best, (odd[name] == best["_same"]) & odd["doc_id"].cast("long").eqNullSafe(best["_id"]), "left_semi").dropDuplicates([name])
    bare = odd.filter(F.col(f"`{name}`").isNull()).dropDuplicates(["doc_id", "text"])
    plain = docs.join(gone, own == gone["id"], "left_anti").join(ids, own.eqNullSafe(ids["id"]), "left_anti")
    return sure.unionByName(plain).unionByName(firsts.drop(name)).unionByName(bare.drop(name))
