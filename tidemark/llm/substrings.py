"""Substring dedup by recompression.

Spark rounds name ever longer symbols, beginning with words. In a round every run of
one symbol, and every pair of a left run and a right one after it (sides are a bit of
the symbol's name), is sent to the bucket of its content; the bucket compares contents,
gives each a name of its own in the whole corpus, and tells whether it occurs more than
once. So equal substrings get equal symbols inside, wherever they stand.

A symbol depends on its neighbours: its evidence is the stretch of words that decides
it, which spans what it joins and the evidence of the symbols on both sides. A window
of words that holds the evidence of a symbol found once occurs once itself. Such
windows are struck off, the symbol ends its stretch, and only symbols that are shared
go on to the next round, so rounds shrink as they go on. Nothing of this depends on how
long runs are.

The windows that no symbol strikes off are verified: they are compared across the
corpus by 128-bit names, polynomials in two independent 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BLOB, CHUNK_BYTES, bucket_bits, buckets, cuts_of, dealt, load, loaded, make_chunks, packed, tasks_of, total_words, unpacked, with_answers
from .common import MIX_A, MIX_B, byte_views, coded, doc_of, drop_dir, mixed, open_fs, release, shared_dir, stored, text_of, words_of
from .quality import Words

ROUNDS = 5
#: In the place of a bucket's number: the row that names the file of what a chunk keeps for itself.
KEPT = -1
BLOBS = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("keys", pa.binary())])


def blob_table(chunk: str, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.string()), pa.array([x for _, x in rows], pa.binary())], schema=BLOBS)


def batch_of(**columns: np.ndarray) -> bytes:
    return packed(pa.record_batch([pa.array(x) for x in columns.values()], names=list(columns)))


def arrays_of(blob: bytes) -> dict[str, np.ndarray]:
    batch = unpacked(blob)
    return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}


#: Bytes of words that are hashed at a time.
HASHED = 1 << 18


def word_hashes(words: pa.Array, seed: np.uint64) -> np.ndarray:
    """64-bit hashes of strings that are not empty: sums of a mixed value for each byte and its place, mixed again."""
    offsets, data = byte_views(words)
    out = np.zeros(len(words), np.uint64)
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASHED, "right")) - 1)
        lo, hi = offsets[at], offsets[to]
        begins = offsets[at:to] - lo
        place = np.arange(hi - lo) - np.repeat(begins, np.diff(offsets[at : to + 1]))
        with np.errstate(over="ignore"):
            out[at:to] = np.add.reduceat(mixed((place.astype(np.uint64) << np.uint64(8) | data[lo:hi]) * MIX_A + seed), begins)
        at = to
    return mixed(out ^ seed)


def sorted_by(first: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order by `first` in which equal rows lie together, whether each differs from the one before).

    Where rows agree in `first`, a 64-bit hash, but not in the others, all columns are sorted.
    """
    differs = lambda order, x: x[order[1:]] != x[order[:-1]]
    order, new = np.argsort(first), np.ones(len(first), bool)
    new[1:] = differs(order, first)
    if any((differs(order, x) & ~new[1:]).any() for x in others):
        order = np.lexsort((*reversed(others), first))
        new[1:] = np.any([differs(order, x) for x in (first, *others)], axis=0)
    return order, new


class Symbols:
    """Named symbols of a chunk in order, with the words [lo, hi) of their evidence; `part` tells stretches apart."""

    def __init__(self, name: np.ndarray, lo: np.ndarray, hi: np.ndarray, part: np.ndarray) -> None:
        self.name, self.lo, self.hi, self.part = name, lo, hi, part

    @classmethod
    def of_words(cls, w: Words) -> Symbols:
        """Words under names whose last four bits are 0."""
        at = np.arange(len(w.codes))
        return cls(w.hash[w.codes] & ~np.uint64(15), at, at + 1, doc_of(w.offsets))

    def joined(self, round_: int) -> tuple[np.ndarray, ...]:
        """(a, r, b, s, lo, hi, part): runs a^r and pairs of runs a^r b^s, without those at the ends of stretches.

        s is 0 for a run alone; one symbol alone has r = 1.
        """
        n = len(self.name)
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.part[1:] != self.part[:-1])
        first = np.flatnonzero(new)
        size, name, part = np.diff(np.append(first, n)), self.name[first], self.part[first]
        right = (mixed(name + np.uint64(round_)) & np.uint64(1)).astype(bool)
        left = np.zeros(len(first), bool)
        left[:-1] = ~right[:-1] & right[1:] & (part[:-1] == part[1:])
        taken = np.zeros(len(first), bool)
        taken[1:] = left[:-1]
        own = np.flatnonzero(~taken)
        pair = left[own]
        near = np.minimum(own + 1, len(first) - 1)
        b, s = np.where(pair, name[near], np.uint64(0)), np.where(pair, size[near], 0)
        a, r = name[own], size[own]
        begin, part = first[own], part[own]
        end = begin + r + s
        inner = np.zeros(len(own), bool)
        inner[1:-1] = (part[:-2] == part[1:-1]) & (part[2:] == part[1:-1])
        a, r, b, s, begin, end, part = (x[inner] for x in (a, r, b, s, begin, end, part))
        return a, r, b, s, self.lo[begin - 1], self.hi[end] if len(end) else end, part


def strike(open_: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> None:
    """Close the windows (by first word) that hold one of the stretches [lo, hi)."""
    held = hi - lo <= window
    lo, hi = lo[held], hi[held]
    edge = np.bincount(np.maximum(0, hi - window), minlength=len(open_) + 1) - np.bincount(lo + 1, minlength=len(open_) + 1)
    open_ &= np.cumsum(edge)[: len(open_)] == 0


def sent_symbols(joined: tuple[np.ndarray, ...], bits: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """(for each symbol its place among the distinct contents sent, -1 for one that keeps its name; blobs by bucket)."""
    a, r, b, s = joined[:4]
    fresh = np.flatnonzero((r > 1) | (s > 0))
    with np.errstate(over="ignore"):
        h = mixed(mixed(mixed(a[fresh] * MIX_A + r[fresh].astype(np.uint64)) + b[fresh]) * MIX_B + s[fresh].astype(np.uint64))
    order, new = sorted_by(h, a[fresh], b[fresh], r[fresh], s[fresh])
    at = fresh[order]
    place = np.full(len(a), -1, np.int32)
    place[at] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(at)))
    kept = at[starts]
    blobs = [(k, batch_of(a=a[kept[x:y]], r=r[kept[x:y]].astype(np.uint32), b=b[kept[x:y]], s=s[kept[x:y]].astype(np.uint32), n=times[x:y].astype(np.uint32))) for k, x, y in cuts_of(buckets(h[order][starts], bits), bits)]
    return place, blobs


def name_symbols(round_: int, bits: int):
    """A bucket's names for the contents sent to it, 0 for a content that occurs once in the corpus."""

    def run(table: pa.Table) -> pa.Table:
        bucket, each = table.column("bucket")[0].as_py(), [arrays_of(x.as_py()) for x in table.column("keys")]
        a, r, b, s, n = (np.concatenate([e[c] for e in each]) for c in ("a", "r", "b", "s", "n"))
        order = np.lexsort((s, r, b, a))
        new = np.ones(len(order), bool)
        x, y = order[1:], order[:-1]
        new[1:] = (a[x] != a[y]) | (b[x] != b[y]) | (r[x] != r[y]) | (s[x] != s[y])
        rank = np.cumsum(new) - 1
        total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        name = (((np.arange(1, len(total) + 1, dtype=np.uint64) << np.uint64(bits)) | np.uint64(bucket)) << np.uint64(4)) | np.uint64(round_)
        name[total < 2] = 0
        out = np.empty(len(order), np.uint64)
        out[order] = name[rank]
        ends = np.cumsum([len(e["a"]) for e in each])
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array([batch_of(name=out[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], schema=BLOBS)

    return run


def in_order(answers: pa.Table, column: str) -> np.ndarray:
    """A chunk's answers from the buckets, in the order it sent."""
    rows = sorted((b, x) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("keys").to_pylist(), strict=True) if b >= 0)
    return np.concatenate([arrays_of(x)[column] for _, x in rows]) if rows else np.zeros(0, np.uint64)


def named(joined: tuple[np.ndarray, ...], place: np.ndarray, answers: np.ndarray, open_: np.ndarray, window: int) -> Symbols:
    """The symbols that go on after their naming; the others strike off windows and end their stretches."""
    a, _, _, _, lo, hi, part = joined
    name = a.copy()
    fresh = place >= 0
    name[fresh] = answers[place[fresh]]
    once = name == 0
    strike(open_, lo[once], hi[once], window)
    goes_on = ~once & (hi - lo <= window)
    breaks = np.cumsum(~goes_on | np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    return Symbols(name[goes_on], lo[goes_on], hi[goes_on], breaks[goes_on])


def first_windows(w: Words, window: int) -> np.ndarray:
    """Whether a window that lies inside one text begins at each word."""
    doc, n = doc_of(w.offsets), len(w.codes)
    out = np.zeros(n, bool)
    if n >= window:
        out[: n - window + 1] = doc[: n - window + 1] == doc[window - 1 :]
    return out


def window_names(w: Words, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of the windows that begin at the words `first`."""
    second = word_hashes(w.distinct, MIX_B)
    found = []
    for h, factor in ((w.hash, MIX_A), (second, MIX_B)):
        with np.errstate(over="ignore"):
            h, size, at, name = mixed(h ^ factor)[w.codes], 1, 0, np.zeros(len(first), np.uint64)
            while True:
                if window & size:
                    name = mixed(name * factor + h[first + at])
                    at += size
                if at == window:
                    break
                h, size = mixed(h[:-size] * factor + h[size:]), 2 * size
        found.append(name)
    return found[0], found[1]


def distinct_names(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the distinct pairs (x, y), sorted; for each pair its place among them; times of each)."""
    order, new = sorted_by(x, y)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return order[starts], own, np.diff(np.append(starts, len(order)))


def shared_windows(table: pa.Table) -> pa.Table:
    """Which of the window names sent occur more than once."""
    each = [arrays_of(x.as_py()) for x in table.column("keys")]
    x, y, n = (np.concatenate([e[c] for e in each]) for c in ("x", "y", "n"))
    at, own, _ = distinct_names(x, y)
    shared = (np.bincount(own, n, len(at)) > 1)[own]
    ends = np.cumsum([len(e["x"]) for e in each])
    return pa.table([table.column("bucket"), table.column("chunk"), pa.array([batch_of(shared=shared[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], schema=BLOBS)


def repeats(docs: DataFrame, window: int = 35, chunk_bytes: int = CHUNK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_text.

    Every word is removed that lies in a window of `window` consecutive words whose
    sequence starts anywhere else too, in the same text or another one; windows are
    judged on the input. Kept words are joined by one space. Null text has no words;
    rows with one doc_id are rows of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    at = shared_dir(spark, "substrings")
    chunks = make_chunks(docs.select(F.col("doc_id").cast("long"), "text"), f"{at}/chunks", size=chunk_bytes)
    n = total_words(chunks)
    bits, window_bits = bucket_bits(n // 4), bucket_bits(n // 3)

    fs, folder = open_fs(at)
    for k in range(2, rounds + 2):
        fs.create_dir(f"{folder}/kept-{k}", recursive=True)

    def words(rows: pa.RecordBatch) -> Words:
        offsets, flat = words_of(text_of(rows.column("text")))
        codes, distinct = coded(flat)
        return Words(offsets, codes, distinct, word_hashes(distinct, MIX_A))

    def keep(round_: int, **columns: bytes) -> tuple[int, bytes]:
        """Write what a chunk keeps for the next round to a new file, and name it in a row."""
        name = f"{at}/kept-{round_}/{uuid.uuid4().hex}"
        store, path = open_fs(name)
        with store.open_output_stream(path) as file:
            file.write(packed(pa.record_batch([pa.array([x], pa.binary()) for x in columns.values()], names=list(columns))))
        return KEPT, name.encode()

    def kept(answers: pa.Table) -> dict[str, bytes]:
        """What the chunk kept, from the file that its row names."""
        rows = answers.filter(pc.equal(answers.column("bucket"), KEPT)).column("keys").to_pylist()
        batch = load(rows[0].decode())
        return {n: batch.column(n)[0].as_py() for n in batch.schema.names}

    def begin(batches):
        """The first round's contents, from the texts."""
        for chunk, rows in loaded(batches):
            yield from blob_table(chunk, sent_symbols(Symbols.of_words(words(rows)).joined(1), bits)[1]).to_batches()

    def round_rows(chunk: str, symbols: Symbols, open_: np.ndarray, round_: int) -> pa.Table:
        """What a chunk sends in a round; it keeps the rest until the answers come."""
        joined = symbols.joined(round_)
        place, blobs = sent_symbols(joined, bits)
        name, lo, hi, part = (joined[i] for i in (0, 4, 5, 6))
        own = batch_of(name=np.where(place >= 0, np.uint64(0), name), place=place, lo=lo.astype(np.uint32), hi=hi.astype(np.uint32), part=part.astype(np.uint32))
        return blob_table(chunk, [*blobs, keep(round_, symbols=own, windows=batch_of(open=open_))])

    def second(chunk, rows, answers):
        """The second round: the first one's contents anew, their names, and what follows."""
        w = words(rows)
        open_, joined = first_windows(w, window), Symbols.of_words(w).joined(1)
        symbols = named(joined, sent_symbols(joined, bits)[0], in_order(answers, "name"), open_, window)
        return round_rows(chunk, symbols, open_, 2)

    def later(round_: int):
        """A further round, or after the last names the windows that are left."""

        def run(table: pa.Table) -> pa.Table:
            chunk, before = table.column("chunk")[0].as_py(), kept(table)
            own, open_ = arrays_of(before["symbols"]), arrays_of(before["windows"])["open"].astype(bool)
            lo, hi = own["lo"].astype(np.int64), own["hi"].astype(np.int64)
            symbols = named((own["name"], None, None, None, lo, hi, own["part"]), own["place"], in_order(table, "name"), open_, window)
            out = round_rows(chunk, symbols, open_, round_) if round_ <= rounds else blob_table(chunk, [keep(round_, windows=batch_of(open=open_))])
            release()
            return out

        return run

    answers = dealt(chunks).mapInArrow(begin, BLOB).groupBy("bucket").applyInArrow(name_symbols(1, bits), BLOB)
    now = stored(with_answers(chunks, answers, second, BLOB), f"{at}/round-2")
    for k in range(2, rounds + 1):
        answers = now.filter("bucket >= 0").groupBy("bucket").applyInArrow(name_symbols(k, bits), BLOB)
        rows = now.filter(F.col("bucket") == KEPT).union(answers).repartition(tasks_of(chunks), "chunk")
        now = stored(rows.groupBy("chunk").applyInArrow(later(k + 1), BLOB), f"{at}/round-{k + 1}")
        drop_dir(spark, f"{at}/round-{k}")
        drop_dir(spark, f"{at}/kept-{k}")
    left = now

    def candidates(rows: pa.RecordBatch, answers: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, tuple]:
        w, first = words(rows), np.flatnonzero(arrays_of(kept(answers)["windows"])["open"])
        x, y = window_names(w, first, window)
        return w, first, x, y, distinct_names(x, y)

    def send_windows(chunk, rows, answers):
        _, _, x, y, (place, _, times) = candidates(rows, answers)
        x, y = x[place], y[place]
        return blob_table(chunk, [(b, batch_of(x=x[i:j], y=y[i:j], n=times[i:j].astype(np.uint32))) for b, i, j in cuts_of(buckets(x, window_bits), window_bits)])

    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def remove(_, rows, answers):
        w, first, _, _, (_, own, _) = candidates(rows, answers)
        found = first[in_order(answers, "shared").astype(bool)[own]]
        edge = np.bincount(found, minlength=len(w.codes) + 1) - np.bincount(found + window, minlength=len(w.codes) + 1)
        gone = np.cumsum(edge)[:-1] > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.offsets])
        texts = []
        for i, x in enumerate(text_of(rows.column("text"))):
            left_over = x.as_py().encode().split()
            if n_removed[i]:
                left_over = [y for y, g in zip(left_over, gone[w.offsets[i] : w.offsets[i + 1]].tolist(), strict=True) if not g]
            texts.append(b" ".join(left_over).decode())
        return pa.table([rows.column("doc_id"), pa.array(np.diff(w.offsets)), pa.array(n_removed), pa.array(texts, pa.string())], schema=out)

    judged = with_answers(chunks, left, send_windows, BLOB).groupBy("bucket").applyInArrow(shared_windows, BLOB)
    return with_answers(chunks, left.union(judged), remove, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
