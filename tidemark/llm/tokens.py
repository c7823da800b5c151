"""Token ids in Arrow files of fixed-size sequences, with random access.

A shard is one Arrow IPC file of record batches with two fixed-size-list columns,
`ids` (the smallest unsigned type that holds the vocabulary) and `mask` (true where an
id is real; only the last row of a shard is padded). Beside it lies an Arrow file
with the place of each document. Every value lies at row // rows_per_batch,
so a memory-mapped reader gets a sequence or a document without copying.

The ids are those of the tokenizers library. Its byte-level BPE never joins a space
that follows a non-space to what stands before it, so texts are cut there and each
distinct piece is encoded once by the library's model, many in one call; ids stand for
bytes, so their widths tell the pieces apart. A text with other white space
around a single space, or with the literal of an added token, goes through the library
as a whole, and so does every text where the file is no byte-level BPE.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_views, open_fs, shared_dir, slices, stored, text_of

#: Pieces that a Python worker remembers; beyond that it encodes them anew.
REMEMBERED = 250_000
#: The pre-tokenizer's pattern and its map of bytes to characters (fixed values of byte-level BPE).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: b for b in PRINTED} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(PRINTED))}
#: The same by byte, as UTF-16; a byte that no text has stands between pre-tokens, and becomes the line's end that the model's splitter takes.
BETWEEN = b"\xff"
SHOWN_BYTES = np.array([SHOWN[b] for b in range(255)] + [10], "<u2")
SPACE_BYTES = np.array([b < 128 and chr(b).isspace() for b in range(256)])
#: Pieces that the model gets at a time.
PORTION = 1 << 16
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        before, model, vocab = parts.get("pre_tokenizer") or {}, parts["model"], parts["model"].get("vocab")
        #: Whether texts may be cut where a pre-token begins: byte-level BPE of all bytes with its own pattern, and nothing before it.
        self.cuts = model["type"] == "BPE" and not parts.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuts = self.cuts and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and all(chr(c) in vocab for c in SHOWN.values())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.known, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.cuts:
            self.tokenizer.model._resize_cache(0)
            #: The same model for pre-tokens that are given one by one, and the bytes that an id stands for.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = CharDelimiterSplit("\n")
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)
            self.width[list(vocab.values())] = list(map(len, vocab))

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) by the library alone."""
        found = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.dtype), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def pieces(self, pre_tokens: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of pieces of so many bytes, given as pre-tokens with `BETWEEN` between them."""
        shown = SHOWN_BYTES[np.frombuffer(pre_tokens, np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.dtype)
        to, ends = np.cumsum(self.width[ids]), np.cumsum(lengths)
        until = np.searchsorted(to, ends, "right")
        if (np.concatenate([[0], to])[until] != ends).any():
            raise ValueError("ids of the tokenizer do not stand for the bytes of its text")
        return ids, np.diff(until, prepend=0)

    def words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(the distinct words in the order of what follows, ids, number of ids of each) of words after a space."""
        plain = pc.ascii_is_alpha(words)
        found = [(np.zeros(0, self.dtype), np.zeros(0, np.int64))]
        kinds = [words.filter(plain).cast(pa.binary()), words.filter(pc.invert(plain)).cast(pa.binary())]
        for kind, between in zip(kinds, (BETWEEN + b" ", b" "), strict=True):
            for at in range(0, len(kind), PORTION):
                part = kind.slice(at, PORTION)
                text = between + pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), between)[0].as_py()
                if between == b" ":  # other words can be several pre-tokens
                    text = BETWEEN.join([x.encode() for x in PATTERN.findall(text.decode())])
                found.append(self.pieces(text, pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) + 1))
        return pa.concat_arrays(kinds).cast(pa.string()), *map(np.concatenate, zip(*found, strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy()
        offsets = (offsets - offsets[0]).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        odd = np.zeros(len(texts), bool)
        odd[doc[loose_ends(distinct)[codes]]] = True
        odd &= np.diff(offsets) > 1
        if not self.cuts:
            odd[:] = True
        for x in self.added:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        if odd.any():
            take = ~odd[doc]
            codes, doc, first = codes[take], doc[take], first[take]
        used = np.zeros(len(distinct), bool)
        used[codes[~first]] = True
        used = np.flatnonzero(used)
        words = distinct.take(pa.array(used))
        at = pc.index_in(words, self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        fresh, ids, sizes = self.words(words.filter(pa.array(new)))
        begin = [x.encode() for x in distinct.take(pa.array(codes[first])).to_pylist()]
        begun = self.pieces(BETWEEN.join([y.encode() for x in begin for y in PATTERN.findall(x.decode())]), np.fromiter(map(len, begin), np.int64, len(begin))) if begin else (ids[:0], sizes[:0])
        whole = np.flatnonzero(odd)
        others = self.whole(texts.take(pa.array(whole)).to_pylist()) if len(whole) else (ids[:0], sizes[:0])
        flat, n_ids = (np.concatenate(x) for x in ((self.ids, ids, begun[0], others[0]), (self.sizes, sizes, begun[1], others[1])))
        place = np.zeros(len(distinct), np.int64)
        place[used] = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)
        place[used[new]] = len(self.sizes) + pc.index_in(words.filter(pa.array(new)), fresh).to_numpy(zero_copy_only=False) if len(fresh) else 0
        row = place[codes]
        row[first] = len(self.sizes) + len(sizes) + np.arange(len(begin))
        if len(whole):
            row = np.concatenate([row, len(n_ids) - len(whole) + np.arange(len(whole))])
            doc = np.concatenate([doc, whole])
            order = np.argsort(doc, kind="stable")
            row, doc = row[order], doc[order]
        self.remember(fresh, ids, sizes)
        starts = np.cumsum(n_ids) - n_ids
        n = n_ids[row]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(starts[row] - before, n) + np.arange(int(n.sum()))] if len(row) else flat[:0]
        return ids, np.bincount(doc, n, len(texts)).astype(np.int64) if len(doc) else np.zeros(len(texts), np.int64)

    def remember(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = min(len(words), REMEMBERED - len(self.known))
        if n > 0:
            self.known, self.sizes = pa.concat_arrays([self.known, words.slice(0, n)]), np.concatenate([self.sizes, sizes[:n]])
            self.ids = np.concatenate([self.ids, ids[: int(sizes[:n].sum())]])


def loose_ends(words: pa.Array) -> np.ndarray:
    """Which words are empty, or begin or end with white space."""
    offsets, data = byte_views(words)
    out = np.diff(offsets) == 0
    if len(data):
        ends = np.stack([data[np.minimum(offsets[:-1], len(data) - 1)], data[offsets[1:] - 1]])
        out |= SPACE_BYTES[ends].any(0)
        beyond = np.flatnonzero((ends > 127).any(0) & ~out)
        out[beyond] = [x[0].isspace() or x[-1].isspace() for x in words.take(pa.array(beyond)).to_pylist()]
    return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


INDEX = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Writes one shard; ids come in any portions."""

    def __init__(self, uri: str, dtype: np.dtype, length: int, rows: int) -> None:
        self.fs, self.path = open_fs(uri)
        self.length, self.rows, self.dtype = length, rows, dtype
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.fs.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.index_out = self.fs.open_output_stream(self.path + ".index")
        self.index = pa.ipc.new_file(self.index_out, INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = self.n_docs = 0

    def add(self, ids: np.ndarray, doc_ids: pa.Array, sizes: np.ndarray) -> None:
        ends = self.n + np.cumsum(sizes)
        self.index.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        self.n_docs += len(sizes)
        full = self.rows * self.length
        if self.n_held >= full:
            held = np.concatenate(self.held)
            to = len(held) // full * full
            for at in range(0, to, full):
                self._batch(held[at : at + full], full)
            self.held, self.n_held = [held[to:]], len(held) - to

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        if len(ids):
            pad = -len(ids) % self.length
            self._batch(np.concatenate([ids, np.zeros(pad, self.dtype)]), len(ids))
        for x in (self.file, self.out, self.index, self.index_out):
            x.close()


class Shard:
    """Random access to a shard: `sequence(i)` and `document(i)` by number."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs as pafs

        fs, path = open_fs(uri)
        opened = pa.memory_map if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.file = pa.ipc.open_file(opened(path))
        self.index = pa.ipc.open_file(opened(path + ".index")).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def _values(self, batch: int, name: str) -> np.ndarray:
        return self.file.get_batch(batch).column(name).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """A view of a sequence's ids, and of its mask, which Arrow packs as bits."""
        batch, row = divmod(i, self.rows)
        at = slice(row * self.length, (row + 1) * self.length)
        return self._values(batch, "ids")[at], self.file.get_batch(batch).column("mask").flatten()[at]

    def span(self, place: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from `place`, one for each batch that holds some."""
        full = self.rows * self.length
        while n > 0:
            batch, at = divmod(place, full)
            part = self._values(batch, "ids")[at : at + n]
            yield part
            place, n = place + len(part), n - len(part)

    def document(self, i: int) -> np.ndarray:
        row = self.index.slice(i, 1).to_pylist()[0]
        return np.concatenate([*self.span(row["place"], row["n_tokens"])])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, length: int = 2048, rows: int = 32) -> DataFrame:
    """Encode `text` of every row and write shards in ascending doc_id order; returns the shards.

    One row for each shard: file, first_id, n_docs, n_tokens, start (ids before it).
    Null text is empty and yields the end id alone; null doc_id comes first; rows with
    one doc_id follow each other by text; other columns are ignored. An empty table
    gives no shard. A task that runs again writes under a new name, and only the
    names of finished tasks are listed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, first = TaskContext.get(), None, None
        enc = encoder(tokenizer)
        uri = f"{path}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        gc.disable()  # encoding makes many small objects and no cycles
        try:
            for part in slices(batches, "text"):
                ids, sizes = enc.encode(text_of(part.column("text")))
                ends = np.cumsum(sizes)
                full = np.insert(ids, ends, enc.dtype.type(end_id))
                if out is None:
                    out, first = ShardWriter(uri, enc.dtype, length, rows), part.column("doc_id")[0].as_py()
                out.add(full, part.column("doc_id"), sizes + 1)
        finally:
            gc.enable()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": uri, "first_id": first, "n_docs": out.n_docs, "n_tokens": out.n}], schema=pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    spark = docs.sparkSession
    fs, at = open_fs(path)
    fs.create_dir(at, recursive=True)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = stored(ordered.mapInArrow(write, "file string, first_id long, n_docs long, n_tokens long"), f"{path}/shards")
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(shards: DataFrame) -> DataFrame:
    """Documents as the files hold them: doc_id, start, n_tokens, ids_crc32 (ids as little-endian 32-bit integers), file."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                places, sizes = (shard.index.column(c).to_numpy() for c in ("place", "n_tokens"))
                crcs = np.zeros(len(places), np.int64)
                full, held, ids = shard.rows * shard.length, -1, None
                for i, (at, n) in enumerate(zip(places.tolist(), sizes.tolist(), strict=True)):
                    crc = 0
                    while n > 0:
                        number, skip = divmod(at, full)
                        if number != held:
                            held, ids = number, shard._values(number, "ids").astype("<u4")
                        part = ids[skip : skip + n]
                        crc = zlib.crc32(part, crc)
                        at, n = at + len(part), n - len(part)
                    crcs[i] = crc
                table = pa.table([shard.index.column("doc_id"), pa.array(places + row["start"]), pa.array(sizes), pa.array(crcs), pa.array([row["file"]] * len(places))], schema=schema)
                yield from table.combine_chunks().to_batches(10_000)

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("file", "start").repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """write_tokens, then read_tokens from the files."""
    return read_tokens(write_tokens(docs, path or shared_dir(docs.sparkSession, "tokens"), tokenizer))


__all__ = ["Encoder", "Shard", "ShardWriter", "read_tokens", "token_table", "write_tokens"]
