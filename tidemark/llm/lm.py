"""Language-model scoring by online logistic context mixing.

A text is coded token by token, each token as a few bits, in this order:

1. is it the token that most often follows the two words before, in the other texts?
2. else, is it the one that most often follows the word before?
3. else, did it occur in this text before? (Which one, by their counts so far.)
4. else, is it known, that is, learned from some other place?
5. for a known token the bits of its frequency class, a Huffman code over the classes;
   tokens of one class are told apart by their shares.

A token that is not known is spelled, bit by bit of its bytes, from contexts of 1 to 6
bytes. Bits 1 and 2 are left out where the context was seen nowhere else.

Each bit is predicted from several hashed contexts: the counts of the corpus in the
bit's own context, and tables of this text that start empty, addressed by the bit alone,
by it and the previous token's last bit, by it and the previous word, and by it and how
much its corpus context has seen. A gate, chosen by the bit's kind and what the corpus
has seen, picks the weights that mix them in the logistic domain. Weights, tables and
the curve that refines the mixed probability take a step after every `STEP` tokens of
the text. Corpus counts are those without the very occurrence that is scored.

Tokens are words with A-Z in lower case, then one end per text, which is the empty word.
Chunks of texts exchange counts with key buckets twice: distinct tokens first, then
distinct triples (two words before, token). A bucket's tables hold what its own keys
need, so all that is gathered grows with the corpus and no task or broadcast does. A
context too frequent for one bucket is narrowed by bits of the words before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BLOB, CHUNK_BYTES, buckets, cuts_of, dealt, loaded, make_chunks, packed, total_words, unpacked, with_answers
from .common import MIX_A, MIX_B, coded, doc_of, hashes, mixed, shared_dir, stored, words_of

#: Added to each count of the base model (fixed value).
ADDED = 0.1
#: Words for each token bucket, triples for each triple bucket, and occurrences from which a context is narrowed.
BUCKET_WORDS, BUCKET_TRIPLES, FREQUENT = 4_000_000, 1_000_000, 1_000_000
CLASSES = 48
HIGH = np.uint64(0xFFFFFFFF00000000)
#: Tokens between steps, rates of weights and curve, cells of a text's table and of the curve.
STEP, RATE, REFINE, SLOTS, CURVE = 16, 0.02, 0.02, 1 << 12, 24
#: Tokens mixed at a time, whole texts, and texts at most.
BATCH_TOKENS, BATCH_TEXTS = 200_000, 4000
#: Added to the corpus's counts for and against the token that is expected.
PRIOR = 0.05
#: Kinds of bits.
TWO, ONE, AGAIN, KNOWN, CLASS = range(5)
INPUTS, TABLES = 6, 4


def level(n: np.ndarray) -> np.ndarray:
    """Counts in steps of a sixth of a doubling, 0 for none; small counts stay exact."""
    out = np.zeros(len(n), np.uint8)
    some = np.flatnonzero(n > 0)
    out[some] = 1 + np.rint(6 * np.log2(n[some]))
    return out


COUNT = np.concatenate([[0.0], 2 ** (np.arange(255) / 6)])
COUNT = np.where(COUNT < 16, np.rint(COUNT), COUNT).astype(np.float32)


def class_of(n: np.ndarray) -> np.ndarray:
    """Frequency class of a count: its binary length less one."""
    return np.minimum(CLASSES - 1, np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1)


def class_codes(mass: np.ndarray) -> list[str]:
    """A Huffman code over the classes by their tokens; classes without tokens have the longest codes."""
    heap = [(max(float(m), 1e-3), k, (k,)) for k, m in enumerate(mass)]
    codes = [""] * len(mass)
    heapq.heapify(heap)
    while len(heap) > 1:
        (m, i, some), (n, j, more) = heapq.heappop(heap), heapq.heappop(heap)
        for k in some:
            codes[k] = "0" + codes[k]
        for k in more:
            codes[k] = "1" + codes[k]
        heapq.heappush(heap, (m + n, min(i, j), some + more))
    return codes


# ---- spelling

ORDERS = (1, 2, 3, 5)
TABLE, BLOCK = 1 << 19, 256
GATES, REFINED = 8 * (len(ORDERS) + 1), 33


def spelled(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, each with its end; token number of each byte; place in its token)."""
    data = np.frombuffer(b"".join(t + b"\n" for t in tokens.to_pylist()), np.uint8)
    sizes = pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return data, owner, np.arange(len(data)) - (np.cumsum(sizes) - sizes)[owner]


def places(data: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the table place of each bit, as rows of 8."""
    high = data >> 4
    nodes = np.empty((len(data), 8), np.int64)
    for t in range(4):
        nodes[:, t] = (1 << t) | (high >> (4 - t))
        nodes[:, 4 + t] = (1 << t) | ((data & 15) >> (4 - t))
    context, groups = np.zeros(len(data), np.uint64), np.uint64(TABLE // 16)
    for k in range(1, ORDERS[-1] + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k].astype(np.uint64) + np.uint64(1)
        before[place < k] = 0
        with np.errstate(over="ignore"):
            context = context * np.uint64(263) + before + np.uint64(k)
            if k in ORDERS:
                first = (mixed(context * MIX_A) % groups).astype(np.int64) * 16
                second = (mixed(context * MIX_A + high + np.uint64(1)) % groups).astype(np.int64) * 16
                yield nodes + np.repeat(np.stack([first, second], 1), 4, axis=1)


def spelling_logs(tokens: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the distinct tokens with a count of 0 or 1, spelled in order; 0 for others.

    A token with a higher count is known wherever it stands. Bit counts are those of all
    learned tokens but the one that is spelled; weights and refinement take a step after
    each block.
    """
    learned = (counts > 0).astype(np.int64)
    table = np.zeros((len(ORDERS), TABLE * 2), np.int32)
    for at in range(0, len(tokens), 64 * BLOCK):
        part = np.flatnonzero(learned[at : at + 64 * BLOCK]) + at
        if len(part):
            data, _, place = spelled(tokens.take(pa.array(part)))
            y = np.unpackbits(data[:, None], axis=1).ravel()
            for k, slot in enumerate(places(data, place)):
                table[k] += np.bincount(slot.ravel() * 2 + y, minlength=TABLE * 2).astype(np.int32)
    weights, past = np.full((GATES, len(ORDERS)), 0.3), np.full((GATES, len(ORDERS)), 1e-4)
    ones = np.tile(8 / (1 + np.exp(-np.linspace(-8, 8, REFINED))), (GATES, 1))
    hits, out, rare = np.full((GATES, REFINED), 8.0), np.zeros(len(tokens)), np.flatnonzero(counts < 2)
    for at in range(0, len(rare), BLOCK):
        now = rare[at : at + BLOCK]
        data, owner, place = spelled(tokens.take(pa.array(now)))
        y, own = np.unpackbits(data[:, None], axis=1).astype(bool), learned[now][owner][:, None]
        reach, inputs = np.zeros(y.shape, np.int64), []
        for k, slot in enumerate(places(data, place)):
            zeros, one = (np.maximum(0, table[k][slot * 2 + b] - np.where(y == b, own, 0)) for b in (0, 1))
            inputs.append(np.log((one + 0.3) / (zeros + 0.3)))
            reach[zeros + one > 0] = k + 1
        gate = reach * 8 + np.arange(8)
        dot = np.clip(sum(weights[gate, k] * x for k, x in enumerate(inputs)), -8, 8)
        p, step = 1 / (1 + np.exp(-dot)), np.rint((dot + 8) * ((REFINED - 1) / 16)).astype(np.int64)
        mix = np.clip((p + (ones / hits)[gate, step]) / 2, 1e-5, 1 - 1e-5)
        out[now] = np.bincount(owner, np.log(np.where(y, mix, 1 - mix)).sum(1), len(now))
        flat, miss = gate.ravel(), y - p
        for k, x in enumerate(inputs):
            slope = np.bincount(flat, (miss * x).ravel(), GATES)
            past[:, k] += slope**2
            weights[:, k] += 0.02 * slope / np.sqrt(past[:, k])
        flat = flat * REFINED + step.ravel()
        hits += np.bincount(flat, minlength=hits.size).reshape(hits.shape)
        ones += np.bincount(flat, y.ravel(), hits.size).reshape(hits.shape)
    return out


# ---- mixing the bits of a text

_seen = np.arange(64, dtype=np.float32)
#: Logistic inputs of a text's tables by (times the bit had this value, times it had the other).
OWN_INPUT = np.log((_seen[:, None] + 0.3) / (_seen[None, :] + 0.3)).astype(np.float32)
#: Weights of the corpus, the four tables and the constant with which every text starts, by kind of bit.
FIRST = np.array([[0.8, 0.15, 0.15, 0.1, 0.2, 0], [0.6, 0.15, 0.1, 0.15, 0.2, 0], [0.3, 0.3, 0.15, 0.15, 0.15, 0], [0.4, 0.25, 0.15, 0.15, 0.2, 0], [0.6, 0.2, 0.1, 0.1, 0.1, 0]], np.float32)
#: Gates: kind of bit, times how much the corpus context has seen (none, one, few, many).
GATE_LEVELS = 4


def mix_bits(text: np.ndarray, step: np.ndarray, corpus: np.ndarray, gate: np.ndarray, slot: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """log2 of the probability of each bit.

    `text` and `step` number the text and its step of each bit, `corpus` is the corpus's
    input towards a one, `slot` has the cells for each of the text's tables. A cell that
    a step meets goes up by one for a value that occurs, and halves for one that does not.
    """
    order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
    cuts = np.flatnonzero(np.diff(step[order], prepend=-1, append=2**40))
    n_texts = int(text.max()) + 1 if len(text) else 0
    text, gate, bit = text[order], gate[order].astype(np.int64), bit[order].astype(np.int64)
    sign = (2 * bit - 1).astype(np.float32)
    given = corpus[order] * sign
    constant = np.float32(0.3) * sign
    rows = text * (len(FIRST) * GATE_LEVELS) + gate
    weights = [np.tile(np.repeat(x, GATE_LEVELS), n_texts) for x in FIRST.T]
    tables = [np.zeros(n_texts * SLOTS * 2, np.uint8) for _ in range(TABLES)]
    base = text * (SLOTS * 2) + bit
    cells = [base + s[order].astype(np.int64) * 2 for s in slot]
    curve = np.tile((1 / (1 + np.exp(-(np.arange(CURVE) + 0.5) / 3))).astype(np.float32), n_texts * len(FIRST))
    bend = (text * len(FIRST) + gate // GATE_LEVELS) * CURVE
    out = np.empty(len(order), np.float32)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        now = slice(lo, hi)
        row = rows[now]
        inputs = [given[now]]
        for table, own in zip(tables, cells, strict=True):
            at = own[now]
            same, other = table[at], table[at ^ 1]
            inputs.append(OWN_INPUT[same, other])
            table[at ^ 1] = np.minimum(other, (other >> 1) + 1)
            table[at] = np.minimum(63, same + 1)
        inputs.append(constant[now])
        dot = weights[0][row] * inputs[0]
        for w, x in zip(weights[1:], inputs[1:], strict=True):
            dot += w[row] * x
        p = 1 / (1 + np.exp(-np.minimum(np.maximum(dot, -16), 16)))
        right = dot >= 0
        near = bend[now] + np.minimum(np.abs(dot) * 3, CURVE - 1).astype(np.int64)
        sure = curve[near]
        out[now] = 0.5 * (p + np.where(right, sure, 1 - sure))
        pull = (1 - p) * np.float32(RATE)
        for w, x in zip(weights, inputs, strict=True):
            np.add.at(w, row, pull * x)
        np.add.at(curve, near, np.float32(REFINE) * (right - sure))
    logs = np.empty(len(order), np.float32)
    logs[order] = np.log2(np.clip(out, 1e-6, 1.0))
    return logs


# ---- texts in chunks


def tokenised(rows: pa.RecordBatch) -> tuple[int, pa.RecordBatch]:
    """A chunk's rows as one row of lists: distinct tokens, and each text's tokens as their numbers."""
    offsets, words = words_of(pc.ascii_lower(rows.column("text")))
    codes, distinct = coded(words)
    n = rows.num_rows
    codes = np.insert(codes, offsets[1:], len(distinct)).astype(np.int32)
    tokens = pa.concat_arrays([distinct.cast(pa.binary()), pa.array([b""], pa.binary())])
    size = pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    each = {"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "size": pa.array(size), "offset": pa.array(offsets + np.arange(n + 1)), "code": pa.array(codes), "token": tokens}
    return len(codes), pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in each.values()], names=list(each))


class ChunkTokens:
    """The tokens of a chunk's texts, ends included, and its distinct tokens by bucket."""

    def __init__(self, row: pa.RecordBatch, bits: int) -> None:
        self.doc_id, self.held_out, size, offset, code, self.tokens = (x.flatten() for x in row.columns)
        self.size, self.offsets, self.codes = size.to_numpy(), offset.to_numpy(), code.to_numpy()
        self.doc = doc_of(self.offsets)
        self.place = np.arange(len(self.codes)) - self.offsets[self.doc]
        self.hash = hashes(self.tokens)
        bucket = buckets(self.hash, bits)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = cuts_of(bucket[self.order], bits)
        self.learned = ~self.held_out.to_numpy(zero_copy_only=False).astype(bool)

    def counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.learned[self.doc]], minlength=len(self.tokens))

    def answered(self, answers: pa.Table, column: str, kind) -> np.ndarray:
        """A column of the token buckets' answers for each distinct token."""
        out, own = np.zeros(len(self.tokens), kind), {b: (i, j) for b, i, j in self.cuts}
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("keys"), strict=True):
            if b >= 0:
                i, j = own[b]
                out[self.order[i:j]] = unpacked(blob.as_py()).column(column).to_numpy()
        return out

    def before(self) -> np.ndarray:
        """How often each token occurred in its text before."""
        key = self.doc * len(self.tokens) + self.codes
        order = np.argsort(key, kind="stable")
        key, at = key[order], np.arange(len(key))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        out = np.empty(len(key), np.int64)
        out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        return out


def shifted(x: np.ndarray, place: np.ndarray, k: int, outside) -> np.ndarray:
    """For each token the value of the one k places before in its text."""
    out = np.full(len(x), outside, x.dtype)
    out[k:] = x[: max(0, len(x) - k)]
    out[place < k] = outside
    return out


class ChunkTriples:
    """The distinct (word before, second word before, token) triples of a chunk, sorted by the key of the context.

    Tokens learned in one place only, and those learned nowhere, are one token here, 0,
    and no context leads through one: what follows it was seen nowhere else. `two` is 0
    where only the word before counts.
    """

    def __init__(self, c: ChunkTokens, counts: np.ndarray) -> None:
        code, n = c.codes, counts
        elsewhere = n > 1
        h = c.hash[code]
        good = [shifted(elsewhere[code], c.place, k, True) for k in (1, 2)]
        freq = [shifted(n[code], c.place, k, 0) for k in (1, 2)]
        self.one, two, three = (shifted(h, c.place, k, k) for k in (1, 2, 3))
        narrow = [np.ceil(np.log2(np.maximum(1, x / FREQUENT))).astype(np.uint64) for x in (freq[0], np.minimum(*freq))]
        with np.errstate(over="ignore"):
            key = mixed(self.one * MIX_A + np.uint64(1))
            for bits, word in zip(narrow, (two, three), strict=True):
                some = np.flatnonzero(bits)
                key[some] = mixed(key[some] * MIX_B + np.uint64(1) + (word[some] >> (np.uint64(64) - bits[some])))
            second = np.where(good[1], (mixed(two) >> np.uint64(40)) | np.uint64(1), np.uint64(0)).astype(np.uint32)
            token = np.where(elsewhere[code], (h & np.uint64(0xFFFFFF)) | np.uint64(1), np.uint64(0)).astype(np.uint32)
            self.used = np.flatnonzero(good[0])
            key, second, token, learned = key[self.used], second[self.used], token[self.used], c.learned[c.doc[self.used]]
            whole = (key & HIGH) | (mixed((key ^ (second.astype(np.uint64) << np.uint64(32))) * MIX_A + (token + (learned.astype(np.uint32) << np.uint32(24)))) >> np.uint64(32))
        order = np.argsort(whole)
        new = np.diff(whole[order], prepend=~whole[order[:1]]) != 0
        self.own = np.empty(len(order), np.int64)
        self.own[order] = np.cumsum(new) - 1
        at = order[new]
        self.key, self.second, self.token = key[at], second[at], token[at]
        #: Times that each triple was learned here; one of a text that is held out has a row of its own, with 0.
        self.n = np.bincount(self.own[learned], minlength=len(at))

    def columns(self, bits: int) -> dict[str, pa.Array]:
        """The triples as they are sent: 32 bits of the key after the bucket's, 24 of the second word and of the token."""
        low = ((self.key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        part = lambda x: {"low": (x & 0xFFFF).astype(np.uint16), "high": (x >> 16).astype(np.uint8)}
        both = {f"{n}_{k}": v for n, x in (("second", self.second), ("token", self.token)) for k, v in part(x).items()}
        return {k: pa.array(v) for k, v in {"key": low, **both, "n": self.n.astype(np.uint32)}.items()}


def sent_triples(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """(key, second, token, n) of batches of `columns`."""
    x = [np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(6)]
    return x[0], x[1] | (x[2].astype(np.uint32) << np.uint32(16)), x[3] | (x[4].astype(np.uint32) << np.uint32(16)), x[5].astype(np.int64)


ANSWER = ("all1", "best1", "all2", "best2", "own")


def followers(context: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row (32-bit context, token, times learned): what its context leads to without one occurrence of the row.

    (Count of the context, count of the token that follows it most often, whether that is
    the row's token.) A row with n = 0 is no occurrence itself. Ties between tokens go to
    the larger number; token 0 is never expected.
    """
    whole = (context.astype(np.uint64) << np.uint64(32)) | token
    order = np.argsort(whole)
    whole = whole[order]
    new = np.flatnonzero(np.diff(whole, prepend=~whole[:1]) != 0)
    total, own_token = np.add.reduceat(n[order], new), whole[new] & ~HIGH
    context = whole[new] >> np.uint64(32)
    first = np.flatnonzero(np.diff(context, prepend=~context[:1]) != 0)
    sizes = np.diff(np.append(first, len(new)))
    owner = np.repeat(np.arange(len(first)), sizes)
    rank = np.where(own_token > 0, total, -1)
    by = np.argsort((owner << 38) | np.minimum(rank + 1, (1 << 38) - 1), kind="stable")
    best = by[first + sizes - 1]
    second = np.where(sizes > 1, by[first + np.maximum(0, sizes - 2)], -1)
    at = np.arange(len(new))
    rival = np.where(at == best[owner], second[owner], best[owner])
    top = np.where(rival >= 0, np.maximum(0, rank[rival]), 0)
    every = np.add.reduceat(total, first)[owner]
    of = np.repeat(at, np.diff(np.append(new, len(order))))
    less = (n[order] > 0).astype(np.int64)
    own = np.where(own_token > 0, total, 0)[of] - np.where((own_token > 0)[of], less, 0)
    is_own = (own > top[of]) | ((own == top[of]) & (own > 0) & (rival < at)[of])
    out = np.empty((3, len(order)), np.int64)
    out[:, order] = every[of] - less, np.where(is_own, own, top[of]), is_own
    return out[0], out[1], out[2]


def _joined(table: pa.Table) -> tuple[list[pa.RecordBatch], np.ndarray]:
    each = [unpacked(x.as_py()) for x in table.column("keys")]
    return each, np.cumsum([b.num_rows for b in each])


def _answers(table: pa.Table, ends: np.ndarray, columns: dict[str, np.ndarray], sign: int = 1) -> pa.Table:
    blobs = [packed(pa.record_batch([pa.array(x[a:b]) for x in columns.values()], names=list(columns))) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    bucket = table.column("bucket") if sign > 0 else pa.array(-1 - table.column("bucket").to_numpy(), pa.int32())
    return pa.table([bucket, table.column("chunk"), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "keys"])


LEARNED = f"{BLOB}, sums array<long>"


def _learn_tokens(table: pa.Table) -> pa.Table:
    """A token bucket: counts and spelling of its tokens; the bucket's tokens by class, and its types and tokens."""
    each, ends = _joined(table)
    own, tokens = coded(pa.concat_arrays([b.column(0) for b in each]))
    counts = np.bincount(own, np.concatenate([b.column(1).to_numpy() for b in each]), len(tokens)).astype(np.int64)
    order = np.argsort(hashes(tokens), kind="stable")
    logs = np.zeros(len(tokens), np.float32)
    logs[order] = spelling_logs(tokens.take(pa.array(order)), counts[order])
    known = counts[counts > 0]
    sums = np.bincount(class_of(known), known, CLASSES).astype(np.int64)
    out = _answers(table, ends, {"n": counts[own], "log": logs[own]})
    return out.append_column("sums", pa.array([[*sums.tolist(), len(known), int(known.sum())]] * len(each), pa.list_(pa.int64())))


def _learn_triples(table: pa.Table) -> pa.Table:
    """A triple bucket: what follows the word before, and the two words before, of each triple sent."""
    each, ends = _joined(table)
    key, second, token, n = sent_triples(each)
    both = (mixed((key.astype(np.uint64) << np.uint64(32)) | second) >> np.uint64(32)).astype(np.uint32)
    columns, own = {}, np.zeros(len(key), np.uint8)
    for k, context in ((1, key), (2, both)):
        all_, best, is_own = followers(context, token, n)
        if k == 2:
            all_[second == 0] = best[second == 0] = is_own[second == 0] = 0
        columns[f"all{k}"], columns[f"best{k}"] = level(all_), level(best)
        own |= (is_own << (k - 1)).astype(np.uint8)
    return _answers(table, ends, {**columns, "own": own}, -1)


def class_nodes(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the classes' Huffman code: lengths, and (class, depth) bits, numbers of nodes, and the corpus's inputs towards a one."""
    codes = class_codes(mass)
    total: dict[str, float] = {}
    for x, m in zip(codes, mass.tolist(), strict=True):
        for d in range(len(x) + 1):
            total[x[:d]] = total.get(x[:d], 0.0) + m
    number = {x: i for i, x in enumerate(sorted(total, key=lambda x: (len(x), x)))}
    width = np.array([len(x) for x in codes])
    bit, node, given = (np.zeros((CLASSES, int(width.max())), t) for t in (np.int64, np.int64, np.float32))
    for q, x in enumerate(codes):
        for d in range(len(x)):
            bit[q, d], node[q, d] = int(x[d]), CLASS + number[x[:d]]
            given[q, d] = np.log((total[x[:d] + "1"] + 0.4) / (total[x[:d] + "0"] + 0.4))
    return width, bit, node, given


def chunk_bits(c: ChunkTokens, t: ChunkTriples, counts: np.ndarray, found: dict[str, np.ndarray], mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log2 of the probability of each token, without the spelling of those that are not known; which tokens these are)."""
    out, unknown = np.zeros(len(c.codes)), np.zeros(len(c.codes), bool)
    before, nodes = c.before(), class_nodes(mass)
    at = 0
    while at < len(c.offsets) - 1:
        to = max(at + 1, min(at + BATCH_TEXTS, int(np.searchsorted(c.offsets, c.offsets[at] + BATCH_TOKENS, "right")) - 1))
        own = slice(int(c.offsets[at]), int(c.offsets[to]))
        out[own], unknown[own] = text_bits(c, t, counts, found, mass, nodes, before, own, at)
        at = to
    return out, unknown


def text_bits(c: ChunkTokens, t: ChunkTriples, counts: np.ndarray, found: dict[str, np.ndarray], mass: np.ndarray, nodes: tuple, before: np.ndarray, own: slice, first: int) -> tuple[np.ndarray, np.ndarray]:
    """chunk_bits of the tokens `own`, which are whole texts from number `first` on."""
    code, doc, size, before = c.codes[own], c.doc[own] - first, c.place[own], before[own]
    less, n, count = c.learned[c.doc[own]].astype(np.float32), len(code), counts[code]
    known = count - less > 0
    done, last, out = np.zeros(n, bool), np.full(n, KNOWN + 2, np.uint8), np.zeros(n)
    # of each kind of bit: (tokens that have one, its value, the corpus's input, how much the corpus has seen, number of the node, trust)
    asked: list[tuple] = []
    near = np.where(shifted(count, size, 1, 2) > 1, 3, 0).astype(np.uint8)

    def ask(at: np.ndarray, value: np.ndarray, corpus: np.ndarray | float, seen: np.ndarray, node: np.ndarray | int, trust: np.ndarray | int = 0) -> None:
        full = lambda x, kind: np.broadcast_to(np.asarray(x, kind), len(at))
        asked.append((at.astype(np.int32), value, full(corpus, np.float32), seen, full(node, np.uint8), full(trust, np.uint8)))

    lo, hi = np.searchsorted(t.used, [own.start, own.stop])
    used, row = t.used[lo:hi] - own.start, t.own[lo:hi]
    for kind, k in ((TWO, 2), (ONE, 1)):
        all_, best, is_own = COUNT[found[f"all{k}"][row]], COUNT[found[f"best{k}"][row]], (found["own"][row] >> (k - 1)) & 1 > 0
        has = (best > 0) & ~done[used]
        at, all_, best, is_own = used[has], all_[has], best[has], is_own[has]
        corpus = np.log((best + PRIOR) / (np.maximum(0, all_ - best) + PRIOR))
        seen = (all_ > 0).astype(np.uint8) + (all_ > 1) + (all_ > 3)
        ask(at, is_own, corpus, seen, kind, np.clip(corpus, 0, 3.9).astype(np.uint8) * 4 + seen)
        done[at[is_own]], last[at[is_own]] = True, kind
    at = np.flatnonzero(~done & (size > 0))
    again = before[at] > 0
    ask(at, again, -0.5, near[at], AGAIN)
    at = at[again]
    done[at], last[at], out[at] = True, AGAIN, np.log2(before[at] / size[at])
    at = np.flatnonzero(~done)
    ask(at, known[at], 1.5, near[at], KNOWN)
    unknown = np.zeros(n, bool)
    unknown[at[~known[at]]] = True
    at = np.flatnonzero(~done & ~unknown)
    last[at] = CLASS
    kind = class_of(counts)[code[at]]
    out[at] = np.log2((count[at] - less[at]) / (mass[kind] - less[at]))
    width, bit, node, given = nodes
    for d in range(bit.shape[1]):
        some = np.flatnonzero(width[kind] > d)
        q = kind[some]
        ask(at[some], bit[q, d] > 0, given[q, d], near[at[some]], node[q, d])
    token, value, corpus, seen, number, trust = (np.concatenate([x[i] for x in asked]) for i in range(6))
    gate = np.minimum(number, CLASS) * np.uint8(GATE_LEVELS) + seen
    last = shifted(last, size, 1, KNOWN + 3)
    with np.errstate(over="ignore"):
        cell = (mixed(np.arange(256 * 256, dtype=np.uint64) * MIX_A) % np.uint64(SLOTS)).astype(np.int32).reshape(256, 256)
        word = (mixed(t.one[own]) % np.uint64(SLOTS)).astype(np.int32)
    slot = [cell[0][number], cell[1 + last[token], number], word[token] ^ cell[100][number], cell[120 + trust, number]]
    logs = mix_bits(doc[token], size[token] // STEP, corpus, gate, slot, value)
    return out + np.bincount(token, logs, n), unknown


def score_texts(docs: DataFrame, held_out: F.Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the rows that are not held out (null counts as not). base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; score is the model's log10
    probability of them, in which an occurrence that was learned does not count for
    itself. Null text is empty and has one token, the end; rows with one doc_id are rows
    of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    at = shared_dir(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    chunks = make_chunks(rows, f"{at}/chunks", ("doc_id", "held_out", "text"), chunk_bytes, tokenised)
    words = total_words(chunks)
    bits = max(2, int(np.ceil(np.log2(max(1, words / BUCKET_WORDS)))))
    triple_bits = max(2, int(np.ceil(np.log2(max(1, 0.7 * words / BUCKET_TRIPLES)))))
    blob_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("keys", pa.binary())])

    def blobs_of(chunk: str, cuts: list[tuple[int, int, int]], columns: dict[str, pa.Array]) -> pa.Table:
        blobs = [packed(pa.record_batch([x[i:j] for x in columns.values()], names=list(columns))) for _, i, j in cuts]
        return pa.table([pa.array([b for b, _, _ in cuts], pa.int32()), pa.array([chunk] * len(cuts), pa.string()), pa.array(blobs, pa.binary())], schema=blob_schema)

    def send_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in loaded(batches):
            c = ChunkTokens(rows, bits)
            yield from blobs_of(chunk, c.cuts, {"token": c.tokens.take(pa.array(c.order)), "n": pa.array(c.counts()[c.order])}).to_batches()

    learned = stored(dealt(chunks).mapInArrow(send_tokens, BLOB).groupBy("bucket").applyInArrow(_learn_tokens, LEARNED), f"{at}/tokens")
    total = np.zeros(CLASSES + 2, np.int64)
    for row in learned.groupBy("bucket").agg(F.first("sums").alias("sums")).toLocalIterator():
        total += np.array(row["sums"])
    mass, n_types, n_tokens = total[:CLASSES], int(total[-2]), int(total[-1])
    learned = learned.drop("sums")

    def send_triples(chunk, rows, answers):
        c = ChunkTokens(rows, bits)
        t = ChunkTriples(c, c.answered(answers, "n", np.int64))
        return blobs_of(chunk, cuts_of(buckets(t.key, triple_bits), triple_bits), t.columns(triple_bits))

    counted = with_answers(chunks, learned, send_triples, BLOB).groupBy("bucket").applyInArrow(_learn_triples, BLOB)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def score(_, rows, answers):
        c = ChunkTokens(rows, bits)
        counts = c.answered(answers, "n", np.int64)
        t = ChunkTriples(c, counts)
        own = {b: slice(i, j) for b, i, j in cuts_of(buckets(t.key, triple_bits), triple_bits)}
        found = {x: np.zeros(len(t.key), np.uint8) for x in ANSWER}
        for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("keys"), strict=True):
            if b < 0:
                got = unpacked(blob.as_py())
                for x in ANSWER:
                    found[x][own[-1 - b]] = got.column(x).to_numpy()
        logs, unknown = chunk_bits(c, t, counts, found, mass)
        logs += np.where(unknown, c.answered(answers, "log", np.float32)[c.codes].astype(np.float64) / np.log(2), 0)
        bits_of = -np.add.reduceat(logs, c.offsets[:-1])
        over = n_tokens + ADDED * (n_types + 1)
        base = np.add.reduceat(np.log10((counts + ADDED) / over)[c.codes], c.offsets[:-1])
        n_known = np.add.reduceat((counts > 0).astype(np.int64)[c.codes], c.offsets[:-1])
        out = [c.doc_id, c.held_out, pa.array(np.diff(c.offsets)), pa.array(n_known), pa.array(np.full(len(c.doc_id), n_tokens)), pa.array(base), pa.array(-bits_of * np.log10(2)), pa.array(bits_of / np.maximum(1, c.size))]
        return pa.table([x.cast(t) for x, t in zip(out, kinds, strict=True)], names=names)

    return with_answers(chunks, learned.unionByName(counted), score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
