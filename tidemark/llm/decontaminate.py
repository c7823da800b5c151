"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all factors of the normalised test items; a text's words are
streamed through it, and the length of the longest match that ends at a word tells
whether a window ends there. Items are handled in blocks of bounded size, each with
its own automaton, so a benchmark of any size needs bounded memory.

Word pairs that no item has cannot lie inside a window, so a vectorised pass first
cuts each text into stretches of item pairs; only those are streamed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, free_name, shared_dir, slices, stored, text_of, words_of

#: Words of items that one automaton holds.
BLOCK_WORDS = 200_000
#: Lower-cases A-Z and blanks what is no word character; bytes of other characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def normal_texts(texts: pa.Array) -> pa.Array:
    """The texts normalised byte by byte; offsets stay as they are."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(data.to_pybytes().translate(NORMAL))], offset=texts.offset)


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        at: list[set[str]] = [set()]
        least = window
        pairs = set()
        coded_items = []
        for item, words in items:
            if words:
                ids = [self.number.setdefault(w, len(self.number)) for w in words]
                coded_items.append((item, ids))
                least = min(least, len(ids))
                pairs.update(zip(ids, ids[1:]))
                last = 0
                for c in ids:
                    last = self._extend(last, c, at)
                    at[last].add(item)
        self.least = least
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[state] >= window and self.length[self.link[state]] >= window:
                at[self.link[state]] |= at[state]
        self.items = at
        #: Short items by the state in which they end, then gathered along the links.
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, ids in coded_items:
            if len(ids) < window:
                state = 0
                for c in ids:
                    state = self.next[state][c]
                self.short.setdefault(state, []).append((len(ids), item))
        if self.short:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                if above := self.short.get(self.link[state]):
                    self.short[state] = above + self.short.get(state, [])
        self.known = len(self.number)
        self.pairs = np.sort(np.array([a * self.known + b for a, b in pairs], np.int64))

    def _extend(self, last: int, c: int, at: list[set[str]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q, at)
        new = self._state({}, length[last] + 1, at)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q, at)
        return new

    def _state(self, edges: dict[int, int], n: int, at: list[set[str]]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(n)
        at.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int, at: list[set[str]]) -> int:
        twin = self._state(dict(self.next[q]), self.length[p] + 1, at)
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, length, items) of each window that occurs in a stretch of word numbers."""
        state = matched = 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state, matched = nxt[state][c], matched + 1
            if matched >= window:
                q = state
                while length[link[q]] >= window:
                    q = link[q]
                yield i + 1, window, self._within(q)
            for n, item in self.short.get(state, ()):
                if n <= matched:
                    yield i + 1, n, {item}

    def _within(self, state: int) -> set[str]:
        return self.items[state]


def hits(texts: pa.Array, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """(offsets of the texts' words, whether each word is hit, items found in each text)."""
    offsets, words = words_of(normal_texts(texts))
    hit, items = np.zeros(len(words), bool), {}
    if not len(words) or not automaton.known:
        return offsets, hit, items
    codes, distinct = coded(words)
    number = np.fromiter((automaton.number.get(w, -1) for w in distinct.cast(pa.binary()).to_pylist()), np.int64, len(distinct))[codes]
    known = number >= 0
    tied = np.zeros(len(words), bool)  # to the word before
    both = np.flatnonzero(known[1:] & known[:-1]) + 1
    keys = number[both - 1] * automaton.known + number[both]
    if len(automaton.pairs):
        place = np.minimum(np.searchsorted(automaton.pairs, keys), len(automaton.pairs) - 1)
        tied[both[automaton.pairs[place] == keys]] = True
    starts_doc = offsets[:-1][np.diff(offsets) > 0]
    tied[starts_doc] = False
    starts = np.flatnonzero(~tied)
    sizes = np.diff(np.append(starts, len(words)))
    for at, n in zip(starts[(sizes >= automaton.least) & known[starts]].tolist(), sizes[(sizes >= automaton.least) & known[starts]].tolist(), strict=True):
        for end, length, found in automaton.matches(number[at : at + n].tolist()):
            hit[at + end - length : at + end] = True
            items.setdefault(int(np.searchsorted(offsets, at, "right")) - 1, set()).update(found)
    return offsets, hit, items


def item_blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata over the items, each over about `block_words` words at most or one item; items without an id are one item, None."""
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = normal_words(row.text)
        if block and n + len(words) > block_words:
            yield Automaton(block, window)
            block, n = [], 0
        block.append((row.item_id, words))
        n += len(words)
    yield Automaton(block, window)


def listed(items: set[str | None]) -> list[str | None]:
    """Items as strings in order, the one without an id first."""
    return sorted(items, key=lambda x: (x is not None, x or ""))


def _digest(items: list[str | None]) -> str:
    return hashlib.sha256(",".join(x or "" for x in items).encode()).hexdigest()


def over_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, last, schema) -> DataFrame:
    """last(batch, offsets of the words, which are hit, items of each text) over the rows of `docs`, with all blocks' hits.

    One block is one pass over the texts. Of several, each is a pass that writes what it
    found of the texts it hit, as bits and items by row number, and never the texts; the
    rows, numbered and written once, are joined with all findings in the end.
    """
    spark, own = docs.sparkSession, docs.columns
    row, bits, found = (free_name(x, own) for x in ("row", "bits", "found"))
    at, rows, findings, old = shared_dir(spark, "blocks"), None, [], None
    blocks = item_blocks(benchmark, window, block_words)
    automaton = next(blocks)
    while automaton is not None:
        following = next(blocks, None)
        if old is not None:
            old.destroy()
        shared = old = spark.sparkContext.broadcast(automaton)
        if following is None and rows is None:

            def only(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for part in slices(batches, "text"):
                    yield last(part, *hits(text_of(part.column("text")), shared.value))

            return docs.mapInArrow(only, schema)
        if rows is None:
            rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), f"{at}/rows")

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                offsets, hit, items = hits(text_of(part.column("text")), shared.value)
                some = sorted(items)
                marks = [np.packbits(hit[offsets[i] : offsets[i + 1]]).tobytes() for i in some]
                yield pa.record_batch([part.column(row).take(pa.array(some, pa.int64())), pa.array(marks, pa.binary()), pa.array([listed(items[i]) for i in some], pa.list_(pa.string()))], names=[row, bits, found])

        kinds = f"`{row}` long, `{bits}` binary, `{found}` array<string>"
        findings.append(stored(rows.select(row, "text").mapInArrow(find, kinds), f"{at}/{len(findings)}"))
        automaton = following
    old.destroy()
    every = findings[0]
    for more in findings[1:]:
        every = every.union(more)
    every = every.groupBy(row).agg(F.collect_list(bits).alias(bits), F.flatten(F.collect_list(found)).alias(found))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            offsets = words_of(normal_texts(text_of(part.column("text"))))[0]
            hit, items = np.zeros(int(offsets[-1]), bool), {}
            for i, (each, names) in enumerate(zip(part.column(bits).to_pylist(), part.column(found).to_pylist(), strict=True)):
                for mark in each or ():
                    n = int(offsets[i + 1] - offsets[i])
                    hit[offsets[i] : offsets[i + 1]] |= np.unpackbits(np.frombuffer(mark, np.uint8), count=n).astype(bool)
                    items.setdefault(i, set()).update(names)
            yield last(part.select(own), offsets, hit, items)

    return rows.join(every, row, "left").select(*(F.col(f"`{c}`") for c in own), bits, found).mapInArrow(merged, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids; one row for each row.

    A window is `window` consecutive words of an item, or a whole shorter item; every
    word inside an occurrence is hit. Null texts have no words, items without words
    match nothing, items of one id count once, those without an id are one item, which is
    none of those named '' and is written as '', an empty benchmark hits nothing and an
    empty table gives no rows.
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"
    none = _digest([])

    def last(part: pa.RecordBatch, offsets: np.ndarray, hit: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
        n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
        names = [listed(items.get(i, set())) for i in range(part.num_rows)]
        return pa.record_batch([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array([_digest(x) if x else none for x in names]), pa.array(n_hit > 0), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"])

    return over_blocks(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, block_words, last, schema)


def cleaned(text: str, hit: np.ndarray) -> str:
    """The text without its hit words; what stands between two of them goes too."""
    spans = [m.span() for m in WORDS.finditer(text)]
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : spans[first][0]])
        at = spans[last - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without their contaminated spans, with the columns of `docs`.

    Spans of hit words are cut from the text; a document of which more than
    `max_coverage` of the words are hit goes as a whole. Documents without a hit,
    null texts included, stay as they are. `n_chars`, where there is one, follows the text.
    """
    names = docs.columns

    def last(part: pa.RecordBatch, offsets: np.ndarray, hit: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
        n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
        rows = np.flatnonzero(n_hit > 0)
        if not len(rows):
            return part
        new = part.column("text").to_pylist()
        for i in rows.tolist():
            new[i] = cleaned(new[i], hit[offsets[i] : offsets[i + 1]])
        columns = {n: part.column(n) for n in names} | {"text": pa.array(new, part.schema.field("text").type)}
        if "n_chars" in columns:
            lengths = columns["n_chars"].to_pylist()
            for i in rows.tolist():
                lengths[i] = len(new[i])
            columns["n_chars"] = pa.array(lengths, part.schema.field("n_chars").type)
        keep = n_hit <= max_coverage * np.diff(offsets)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], schema=part.schema).filter(pa.array(keep))

    return over_blocks(docs, benchmark, window, block_words, last, docs.schema)
