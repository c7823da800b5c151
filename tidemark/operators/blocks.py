"""Labelled sparse rows in blocks of columns, and sums over all blocks, which models are fitted by.

A block holds some thousand rows. Their features' values are cut at thresholds; a slot is a
feature and a range of its values above zero. The rows of each slot stand together, so those
that a split sends to the right are one slice, and sums for all slots are one gather and a
running sum over the values there are, not over a row's zeros. A block takes 2 bytes for each
value, 6 with the times it occurs.

A fit is a function of one that sums: `total = passes(work)` adds `work(block)` over all
blocks. Few blocks are fitted in one task, so that hundreds of passes start no job; more are
read by a job for each pass, whose few tasks send their sums to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .terms import Terms, parts, unpacked

#: Slots of a feature at most; zero has none.
SLOTS = 31
#: Rows of a block at most; a row's number has 16 bits.
BLOCK = 1 << 14
#: Values of all blocks that one task fits by itself.
HERE = 1 << 25
#: Copies of a text beyond which they are dealt over the blocks.
COPIES = 1000
COLUMNS = {"id": "long", "y": "binary", "rows": "binary", "starts": "binary", "times": "binary", "norm": "binary"}
KINDS = {"y": np.uint8, "rows": np.uint16, "starts": np.int32, "times": np.uint32, "norm": np.float64}


class Block(NamedTuple):
    """Rows by slot: those of slot s are rows[starts[s]:starts[s + 1]]."""

    id: int
    y: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    times: np.ndarray | None = None
    norm: np.ndarray | None = None


Passes = Callable[[Callable[[Block], np.ndarray]], np.ndarray]


@dataclass(frozen=True)
class Slots:
    """The threshold below each slot; those of feature f begin at base[f]."""

    cuts: np.ndarray
    base: np.ndarray

    @property
    def feature(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.base) - 1), np.diff(self.base))

    @property
    def ends(self) -> np.ndarray:
        """For each slot the one after its feature's last."""
        return np.repeat(self.base[1:], np.diff(self.base))

    def of(self, term: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The slot of each value above zero."""
        return np.searchsorted(self.feature * 2.0 + self.cuts, term * 2.0 + x) - 1


def cut(rows: DataFrame, terms: Terms) -> Slots:
    """Thresholds from all rows: below a feature's least value, and where so many of its values lie below.

    Values are told apart by 9 bits of their fraction.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, times = (unpacked(batch.column(c), k) for c, k in (("term", np.uint16), ("times", np.uint32)))
            row = np.repeat(np.arange(batch.num_rows), [len(x.as_buffer()) // 2 for x in batch.column("term")])
            x, _ = terms.weights(row, term, times, batch.num_rows)
            key, n = np.unique(term.astype(np.int64) << 32 | x.astype(np.float32).view(np.uint32) >> 14, return_counts=True)
            yield from pa.table([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["f", "v", "n"]).to_batches(1 << 16)

    def own(table: pa.Table) -> pa.Table:
        v, place = np.unique(table.column("v").to_numpy(), return_inverse=True)
        below = np.bincount(place, table.column("n").to_numpy()).cumsum()
        last = np.arange(len(v) - 1) if len(v) <= SLOTS else np.unique(np.searchsorted(below, np.arange(1, SLOTS) * below[-1] / SLOTS))
        last = last[last < len(v) - 1]
        least = lambda a: (a.astype(np.uint32) << 14).view(np.float32).astype(np.float64)
        cuts = np.concatenate([least(v[:1]) / 2, (least(v[last] + 1) + least(v[last + 1])) / 2])
        return pa.table([table.column("f").slice(0, 1), pa.array([cuts.tolist()])], names=["f", "cuts"])

    counted = rows.select("term", "times").mapInArrow(run, "f int, v int, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    each = dict(tuple(r) for r in counted.groupBy("f").applyInArrow(own, "f int, cuts array<double>").collect())  # bounded by the features
    return Slots(np.array([x for f in sorted(each) for x in each[f]]), np.cumsum([0, *(len(each.get(f, ())) for f in range(len(terms.names)))]))


def block(id: int, y: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, terms: Terms, slots: Slots) -> Block:
    x, norm = terms.weights(row, term, times, len(y))
    slot = slots.of(term, x)
    order = np.argsort(slot, kind="stable")
    starts = np.cumsum([0, *np.bincount(slot, minlength=len(slots.cuts))])
    return Block(id, y.astype(np.uint8), row[order].astype(np.uint16), starts.astype(np.int32), times[order].astype(np.uint32), norm)


def record(b: Block) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b.id]), *(pa.array([getattr(b, c).tobytes()], pa.binary()) for c in KINDS)], names=list(COLUMNS))


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(*(batch.column(c)[i].as_py() if c == "id" else np.frombuffer(batch.column(c)[i].as_buffer(), KINDS[c]) for c in batch.schema.names))


def here(blocks: list[Block]) -> Passes:
    def passes(work: Callable[[Block], np.ndarray]) -> np.ndarray:
        total = work(blocks[0])
        for b in blocks[1:]:
            total += work(b)
        return total

    return passes


def spread(blocks: DataFrame) -> Passes:
    """A job for each pass; a task sends its sums without zeros where these are the most."""

    def passes(work: Callable[[Block], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in read(batches):
                total = work(b) if total is None else np.add(total, work(b), out=total)
            if total is not None:
                at = np.flatnonzero(total).astype(np.int32)
                few = len(at) * 12 < total.nbytes
                sent = (at.tobytes(), total[at].tobytes()) if few else (None, total.tobytes())
                yield pa.record_batch([pa.array([total.dtype.str]), pa.array([len(total)]), *(pa.array([x], pa.binary()) for x in sent)], names=["kind", "size", "at", "x"])

        total = None
        for r in blocks.mapInArrow(run, "kind string, size long, at binary, x binary").collect():  # bounded: parts() rows
            total = np.zeros(r["size"], r["kind"]) if total is None else total
            x = np.frombuffer(r["x"], r["kind"])
            if r["at"] is None:
                total += x
            else:
                total[np.frombuffer(r["at"], np.int32)] += x
        return total

    return passes


@dataclass(frozen=True)
class Blocks:
    """Stored blocks of n rows, and what their slots are."""

    df: DataFrame
    n: int
    values: int
    terms: Terms
    slots: Slots

    def fit(self, learn: Callable[[Passes, Slots], Any], whole: bool = False, limit: int | None = None) -> Any:
        """What `learn` makes of the blocks, in one task if these are few; with `whole` they have all columns."""
        rows, slots = self.df.select(*(COLUMNS if whole else list(COLUMNS)[:4])), self.slots
        if self.values > (getattr(learn, "here", HERE) if limit is None else limit):
            return learn(spread(rows.coalesce(parts(rows))), slots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = list(read(batches))
            if blocks:
                yield pa.record_batch([pa.array([pickle.dumps(learn(here(sorted(blocks, key=lambda b: b.id)), slots))], pa.binary())], names=["made"])

        return pickle.loads(rows.coalesce(1).mapInArrow(run, "made binary").first()["made"])


def blocks(rows: DataFrame, n: int, wanted: int, terms: Terms) -> Blocks:
    """Encoded rows (h, y, term, times) in about `wanted` blocks, by h, in its order; copies beyond some are dealt out."""
    slots = cut(rows, terms)
    copied = [r["h"] for r in rows.groupBy("h").count().filter(F.col("count") > COPIES).collect()]  # at most n / COPIES
    place = F.when(F.col("h").isin(copied), F.xxhash64("h", F.monotonically_increasing_id())).otherwise(F.col("h")) if copied else F.col("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int32()), ("h", pa.int64()), ("y", pa.int32()), ("term", pa.binary()), ("times", pa.binary())]))
        all_ = all_.sort_by([("id", "ascending"), ("h", "ascending"), ("y", "ascending")])
        ids = all_.column("id").to_numpy()
        for i in np.unique(ids).tolist():
            first, end = np.searchsorted(ids, [i, i + 1]).tolist()
            for k, at in enumerate(range(first, end, BLOCK)):
                some = all_.slice(at, min(BLOCK, end - at)).combine_chunks()
                term, times = (np.concatenate([unpacked(c, kind) for c in some.column(name).chunks]) for name, kind in (("term", np.uint16), ("times", np.uint32)))
                row = np.repeat(np.arange(some.num_rows), [len(x.as_buffer()) // 2 for c in some.column("term").chunks for x in c])
                yield record(block(i + (k << 32), some.column("y").to_numpy(), row, term, times, terms, slots))

    dealt = rows.select(F.pmod(place, F.lit(wanted)).cast("int").alias("id"), "h", "y", "term", "times").repartitionById(wanted, "id")
    made = stored(dealt.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in COLUMNS.items())), "blocks")
    values = made.agg(F.sum(F.length("rows"))).first()[0] // 2
    return Blocks(made, n, values, terms, slots)
