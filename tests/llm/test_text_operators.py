"""Operators against brute force, on texts with every edge."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, linededup, lm, neardup, quality, queries, secrets, substrings
from tidemark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def window_hits(docs, window):
    counts = collections.Counter(tuple(w[p : p + window]) for _, w in docs for p in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if counts[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "size"), [(35, 400), (35, 1 << 20), (12, 700), (4, 1000)])
def test_substrings(make, corpus, window, size):
    got = rows_of(substrings.repeats(make(corpus, 3), window, size))
    assert got == window_hits([(i, words(t)) for i, t in corpus], window)


def test_substrings_hash_words_at_once_and_sort_by_one_column(monkeypatch):
    words = pa.array([f"{a}{b}" for a in ("", "x", "ñ", "ab", "long" * 50) for b in range(400)] + ["a\0", "a", "\0a", "aa"])
    a, b = (substrings.word_hashes(words, x) for x in (substrings.MIX_A, substrings.MIX_B))
    assert len({*a.tolist()}) == len({*b.tolist()}) == len(words) and not {*a.tolist()} & {*b.tolist()}
    monkeypatch.setattr(substrings, "HASHED", 7)
    assert (substrings.word_hashes(words, substrings.MIX_A) == a).all() and (substrings.word_hashes(words[5:9], substrings.MIX_A) == a[5:9]).all()
    x, y = np.array([3, 1, 3, 1, 3], np.uint64), np.array([5, 0, 4, 0, 5], np.uint64)  # two contents under one hash
    at, own, times = substrings.distinct_names(x, y)
    assert [(x[i], y[i], n) for i, n in zip(at, times)] == [(1, 0, 2), (3, 4, 1), (3, 5, 2)] and own.tolist() == [2, 0, 1, 0, 2]
    assert substrings.sorted_by(x[:0], y[:0])[0].tolist() == []


def test_substrings_of_periodic_text(make):
    rows = [(i, "a b " * n + "c") for i, n in ((1, 60), (2, 45))] + [(3, "a " * 50), (4, "x y z " * 30), (5, "q " + "x y z " * 12)]
    assert rows_of(substrings.repeats(make(rows), 35, 200)) == window_hits([(i, words(t)) for i, t in rows], 35)


def test_window_names_are_compared_whole():
    import numpy as np

    name = np.array([7, 7, 9], np.uint64)
    blobs = [substrings.batch_of(x=name, y=np.array(y, np.uint64), n=np.array([1, 1, n], np.uint32)) for y, n in (([1, 2, 3], 1), ([2, 5, 4], 2))]
    table = substrings.blob_table("c", [(0, b) for b in blobs])
    got = [substrings.arrays_of(x.as_py())["shared"].tolist() for x in substrings.shared_windows(table).column("keys")]
    assert got == [[False, True, False], [True, False, True]], "equal first halves alone are no repeat"


def test_symbols_are_named_by_content():
    import numpy as np

    content = lambda a, r, b, s: substrings.batch_of(a=np.array(a, np.uint64), r=np.array(r, np.uint32), b=np.array(b, np.uint64), s=np.array(s, np.uint32), n=np.ones(len(a), np.uint32))
    table = substrings.blob_table("c", [(3, content([5, 5, 6], [1, 2, 1], [8, 8, 8], [1, 1, 1])), (3, content([5, 6], [2, 1], [8, 9], [1, 1]))])
    names = [substrings.arrays_of(x.as_py())["name"].tolist() for x in substrings.name_symbols(2, 30)(table).column("keys")]
    assert names[0][0] == names[0][2] == names[1][1] == 0 and names[0][1] == names[1][0] > 0 and names[0][1] & 15 == 2


@pytest.mark.parametrize("bits", [2, 24, 25, 33])
def test_keys_of_any_number_of_buckets(bits):
    import numpy as np

    from tidemark.llm.chunks import buckets, cuts_of, low_bits

    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    own = buckets(keys, bits)
    assert (np.diff(own) >= 0).all() and own.max() < 1 << bits
    whole = [(int(b) << 40) | int(x) for b, x in zip(own, low_bits(keys, bits))]
    assert whole == sorted(whole) and all(int(k) >> max(0, 24 - bits) == w >> max(0, bits - 24) for k, w in zip(keys, whole))
    assert [(b, j - i) for b, i, j in cuts_of(own, bits)] == sorted(collections.Counter(own.tolist()).items())


def brute_base(docs, learned):
    count = collections.Counter(x for i, w in docs if learned(i) for x in w)
    n, v = sum(count.values()), len(count)
    return count, [(i, not learned(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in docs]


def brute_score(docs, learned):
    """Each text's log10 probability, bit after bit, with counts from plain loops over the texts."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    from tidemark.llm.common import MIX_A, mixed

    hash_ = lambda x: xxhash.xxh3_64_intdigest(x.encode())
    number = lambda x: (hash_(x) & 0xFFFFFF) | 1 if count[x] > 1 else 0
    about = lambda n: float(lm.COUNT[lm.level(np.array([n]))[0]])
    mix = lambda x: int(mixed(np.array([x % 2**64], np.uint64))[0])
    cell = lambda i, j: mix((i * 256 + j) * int(MIX_A)) % lm.SLOTS
    count, _ = brute_base(docs, learned)
    kind = lambda x: max(1, count[x]).bit_length() - 1
    mass = np.bincount([kind(x) for x in count], [count[x] for x in count], lm.CLASSES)
    width, bits, nodes, given = lm.class_nodes(mass)
    tokens = sorted({x for _, w in docs for x in w}, key=hash_)
    logs = {}
    for bucket in range(4):
        if own := [x for x in tokens if hash_(x) >> 62 == bucket]:
            logs |= dict(zip(own, lm.spelling_logs(pa.array([x.encode() for x in own], pa.binary()), np.array([count[x] for x in own]))))
    after = collections.defaultdict(collections.Counter)
    back = lambda w, p, k: (*w[max(0, p - k) : p], k) if p >= k else ("", *w[:p], "start", k)
    for i, w in docs:
        if learned(i):
            for p, x in enumerate(w):
                for k in (1, 2):
                    after[back(w, p, k)][number(x)] += 1
    out = []
    for i, w in docs:
        less, total, last, seen_here = int(learned(i)), 0.0, lm.KNOWN + 3, collections.Counter()
        weights = {(r, g): lm.FIRST[r].astype(float) for r in range(5) for g in range(4)}
        tables, curve, asked = [collections.Counter() for _ in range(4)], {}, []
        for p, x in enumerate(w):
            known, found = count[x] - less > 0, False
            near = 3 if p == 0 or count[w[p - 1]] > 1 else 0
            one = hash_(w[p - 1]) if p else 1
            ask = lambda node, bit, corpus, seen, trust=0: asked.append((min(node, 4), seen, int(bit), float(np.float32(corpus)), [cell(0, node), cell(1 + last, node), mix(one) % lm.SLOTS ^ cell(100, node), cell(120 + trust, node)]))  # noqa: B023, E731
            for rung, k in ((lm.TWO, 2), (lm.ONE, 1)):
                if not found and all(p < j or count[w[p - j]] > 1 for j in range(1, k + 1)):
                    near_tokens = after[back(w, p, k)]
                    own = near_tokens[number(x)] - less if number(x) else 0
                    rival = max(((n, y) for y, n in near_tokens.items() if y and y != number(x)), default=(0, 0))
                    top = rival[0]
                    mine = own > top or own == top and own > 0 and number(x) > rival[1]
                    best = about(own if mine else top)
                    every = about(sum(near_tokens.values()) - less)
                    if best > 0:
                        seen = (every > 0) + (every > 1) + (every > 3)
                        corpus = math.log((best + lm.PRIOR) / (max(0, every - best) + lm.PRIOR))
                        ask(rung, mine, corpus, seen, int(min(3.9, max(0, corpus))) * 4 + seen)
                        if mine:
                            found, this = True, rung
            if not found and p:
                ask(lm.AGAIN, seen_here[x] > 0, -0.5, near)
                if seen_here[x]:
                    found, this = True, lm.AGAIN
                    total += math.log10(seen_here[x] / p)
            if not found:
                ask(lm.KNOWN, known, 1.5, near)
                this = lm.KNOWN + 2
                if known:
                    this, q = lm.CLASS, kind(x)
                    total += math.log10((count[x] - less) / (mass[q] - less))
                    for d in range(width[q]):
                        ask(int(nodes[q, d]), bits[q, d], given[q, d], near)
                else:
                    total += float(logs[x]) / math.log(10)
            seen_here[x] += 1
            last = this
            if p % lm.STEP == lm.STEP - 1 or p == len(w) - 1:
                steps, cells = [], [{} for _ in range(4)]
                for rung, seen, bit, corpus, slots in asked:
                    sign = 2 * bit - 1
                    inputs = [corpus * sign]
                    for t, s in enumerate(slots):
                        inputs.append(math.log((tables[t][s, bit] + 0.3) / (tables[t][s, 1 - bit] + 0.3)))
                        cells[t].setdefault(s, set()).add(bit)
                    inputs = np.array([*inputs, 0.3 * sign])
                    dot = float(weights[rung, seen] @ inputs)
                    chance = 1 / (1 + math.exp(-min(16, max(-16, dot))))
                    at = rung, int(min(abs(dot) * 3, lm.CURVE - 1))
                    sure = curve.get(at, 1 / (1 + math.exp(-(at[1] + 0.5) / 3)))
                    total += math.log10(max(1e-6, 0.5 * (chance + (sure if dot >= 0 else 1 - sure))))
                    steps.append((rung, seen, lm.RATE * (1 - chance) * inputs, at, sure, dot >= 0))
                for rung, seen, step, *_ in steps:
                    weights[rung, seen] = weights[rung, seen] + step
                for *_, at, sure, right in steps:
                    curve[at] = curve.get(at, sure) + lm.REFINE * (right - sure)
                for t in range(4):
                    for s, values in cells[t].items():
                        was = tables[t][s, 0], tables[t][s, 1]
                        for v in (0, 1):
                            tables[t][s, v] = min(63, was[v] + 1) if v in values else min(was[v], was[v] // 2 + 1)
                asked = []
        out.append(total)
    return out


def test_lm(make, corpus):
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    rows = [r for r in corpus if r[0] != 77 and (r[0] or 0) % 2 == 0]
    docs = [(i, words((t or "").translate(LOWER)) + [""]) for i, t in rows]
    learned = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    _, base = brute_base(docs, learned)
    got = lm.score_texts(make(rows), held, 2000).collect()
    key = lambda r: (repr(r[0]), r[2], r[3])
    assert len(got) == len(base)
    for g, (b, score) in zip(sorted(got, key=key), sorted(zip(base, brute_score(docs, learned)), key=lambda x: key(x[0]))):
        assert tuple(g)[:5] == b[:5] and g.base_score == pytest.approx(b[5], rel=1e-9)
        assert g.score == pytest.approx(score, rel=2e-3) and g.bits_per_byte > 0
    again = {r.doc_id: r.score for r in lm.score_texts(make(rows, 5), held, 9000).collect()}
    assert all(again[g.doc_id] == pytest.approx(g.score, rel=1e-4) for g in got)


def test_lm_knows_copies_and_narrows_frequent_contexts(make, monkeypatch):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    vocabulary = [a + b + c for a in "bdgklmnprst" for b in ("a", "e", "ia", "or") for c in ("n", "k", "sh", "lo", "mi", "ta")]
    rows = [(i, " ".join(("the " if r.random() < 0.5 else "") + r.choice(vocabulary) for _ in range(60))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(3)]
    for frequent in (lm.FREQUENT, 20):
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got = {x.doc_id: x.bits_per_byte for x in lm.score_texts(make(rows), F.col("doc_id") == 102).collect()}
        assert max(got[i] for i in (0, 1, 100, 101, 102)) < (0.75 if frequent > 20 else 1) * min(got[i] for i in range(2, 40)), "2 was learned from itself alone"


def test_lm_of_long_tokens_and_texts(make):
    """Spelling has no floor, and a long text is scored as a whole."""
    from pyspark.sql import functions as F

    import random

    r = random.Random(4)
    noise = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (200, 400)]
    rows = [(1, noise[0]), (2, noise[1]), (3, "a b " * 3000), (4, None)]
    got = {x.doc_id: x for x in lm.score_texts(make(rows), F.lit(False)).collect()}
    assert got[2].score < 1.5 * got[1].score < -200 and got[3].n_tokens == 6001 and got[4].n_tokens == 1
    picture = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000))
    got = {x.doc_id: x for x in lm.score_texts(make([(1, picture), (2, picture[::-1]), (3, "a b")]), F.col("doc_id") == 2).collect()}
    assert all(-1e6 < got[i].score < -5e4 and 0 < got[i].bits_per_byte < 40 for i in (1, 2)), "finite for one huge word, learned or not"


def test_spelling_is_a_distribution():
    """Over all one-byte words and the end, probabilities add up to one at most while nothing is learned."""
    import numpy as np
    import pyarrow as pa

    every = [b"", *(bytes([b]) for b in range(256) if b != 10)]
    assert 0 < sum(np.exp(lm.spelling_logs(pa.array([x], pa.binary()), np.array([0])))[0] for x in every) <= 1 + 1e-6
    logs = lm.spelling_logs(pa.array([b"abab", b"abba", b"baab", b"ab", b"zq"], pa.binary()), np.array([5, 1, 2, 0, 0]))
    assert logs[3] > logs[4]


def brute_lines(docs):
    """The rule of the chunks, line by line, over rows with distinct ids."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    chunks, seen, out = {}, {}, []
    for i, t in docs:
        lines, ended, own = (t or "").split("\n"), False, [[]]
        for k, line in enumerate(lines):
            own[-1].append(line)
            before = md5(lines[k - 1]) if k else ""
            ended = (k > 0 and lines[k - 1] == line or md5(before + md5(line))[0] < "8") and not ended
            if ended:
                own.append([])
        chunks[i] = ["\n".join(c) for c in own if c]
    order = [(i, k) for i in sorted(chunks, key=lambda i: (i is not None, i)) for k in range(len(chunks[i]))]
    for i, k in order:
        if "\n" in chunks[i][k]:
            seen.setdefault(chunks[i][k], []).append((i, k))
    lines = {(i, k): chunks[i][k].split("\n") for i, k in order}
    left = {at: [True] * len(x) for at, x in lines.items()}
    for where in seen.values():
        for i, k in where[1:]:
            left[i, k] = [False] * len(left[i, k])
            for step in (-1, 1):
                near, other = (i, k + step), (where[0][0], where[0][1] + step)
                if near in lines and other in lines and near not in seen.get(chunks[i][k + step], [])[1:]:
                    for n, (x, y) in enumerate(zip(lines[near][::step], lines[other][::step], strict=False)):
                        if x != y:
                            break
                        left[near][n if step == 1 else -1 - n] = False
    for i in chunks:
        every = [(x, y) for k in range(len(chunks[i])) for x, y in zip(lines[i, k], left[i, k], strict=True)]
        out.append((i, len(every), sum(not y for _, y in every), hashlib.sha256("\n".join(x for x, y in every if y).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(make, spark):
    import random

    r = random.Random(6)
    passage = "\n".join(f"line {r.random()}" for _ in range(12))
    rows = [(1, "a\nb\nc\nd\ne\nf"), (2, "x\na\nb\nc\nd\ne\nf"), (3, None), (4, ""), (5, "\n\n"), (6, "a\nb\nc\nd\ne\nf\na\nb\nc\nd\ne\nf"), (7, "k\n" * 40), (8, "k\n" * 41), (9, "no lines " * 500), (None, "a\nb\nc\nd\ne\nf")]
    rows += [(20 + i, "\n".join([*(f"own {r.random()}" for _ in range(r.randint(1, 9))), passage, *(f"own {r.random()}" for _ in range(5))])) for i in range(12)]
    docs = make(rows)
    from pyspark.sql import functions as F

    got = rows_of(linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256)))
    assert got == brute_lines(rows)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert got == sorted(con.sql(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({linededup.ORACLE_SQL})").fetchall(), key=repr)
    assert all(x[2] >= 10 for x in got if (x[0] or 0) > 20) and next(x for x in got if x[0] == 7)[2] >= 36, "a repeated passage goes but for a line or two where chunks differ, and most of a run"
    names = str(linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan())
    assert "Python" not in names and "Arrow" not in names


def test_line_dedup_goes_on_line_by_line(make):
    import random

    from pyspark.sql import functions as F

    r = random.Random(16)
    own = lambda most: [f"own {r.random()}" for _ in range(r.randint(0, most))]
    rows = []
    for i in range(120):
        passage = [f"line {r.random()}" for _ in range(10)]
        rows += [(2 * i, "\n".join([*own(7), *passage, *own(7)])), (2 * i + 1, "\n".join([*own(7), *passage, *own(7)]))]
    shared = [f"part {k}" for k in range(9)]
    rows += [(1000 + i, "\n".join([*own(3), *shared[r.randint(0, 4) : r.randint(5, 9)], *own(3), *shared[: r.randint(2, 9)]])) for i in range(60)]
    docs = make(rows)
    got = rows_of(linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256)))
    assert got == brute_lines(rows)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert got == sorted(con.sql(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({linededup.ORACLE_SQL})").fetchall(), key=repr)
    copies = [x for x in got if x[0] < 240 and x[0] % 2]
    assert sum(x[2] for x in copies) > 0.8 * 10 * len(copies), sum(x[2] for x in copies)
    assert all(x[2] == 0 for x in got if x[0] < 240 and x[0] % 2 == 0), "the first occurrence stays"


def test_line_dedup_of_repeated_and_null_ids(make):
    text = "\n".join(f"line {i}" for i in range(30))
    got = rows_of(linededup.dedup_lines(make([(1, text), (1, text), (1, "other"), (None, text + "\nx"), (None, "y")])).select("doc_id", "n_lines", "n_removed"))
    assert [g[0] for g in got] == [1, 1, 1, None, None] and [g[2] for g in got if g[0] is None] == [0, 0]
    assert [g[2] > 20 for g in got if g[1] == 30] == [True, True], "a null id comes first"


def test_line_dedup_is_linear(make):
    import time

    text = "\n".join(str(i * 7919 % 100_003) for i in range(200_000))
    began = time.time()
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(make([(1, text), (2, text)])).collect()}
    assert got[2] > 190_000
    assert time.time() - began < 300, "a quadratic way takes far longer"


def test_secrets(make):
    hexes, access = "0123456789abcdef0123456789", "AKIA" + "Q7" * 9
    rows = [
        (1, f'password = "hunter22" é {hexes} TOKEN:abc Secret=x1y2z3\n{access}'), (2, f"api_key={access} AKIA short AKIAAKIA{'Z' * 20}"), (3, None), (4, ""), (5, "token=password=abcdef"),
        (6, "Bearer abcdefghijklmnop0123 and ghp_abcdefghijklmnop1234"), (7, "x Bearer abcdefghijklmnop0123"), (8, "𝄞 passwd:  'ab' apikey='abcdef'"), (8, "ſecret=abcdefg toKen=abcdefg"),
    ]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rows += [(9, "x " * 100_000 + "token=abcdef"), (None, "token=abcdef"), (None, "nothing"), (10, "token=abcdef"), (10, "nothing"), (10, "token=abcdef")]
    spans_of = lambda t: [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(((assign, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))) for m in p.finditer(t or "") if len(m[g]) >= n]
    want = []
    for i, t in rows:
        found = spans_of(t)
        spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        want.append((i, *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(spans.encode()).hexdigest(), spans))
    got = rows_of(secrets.find_secrets(make(rows)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=repr)]
    assert all(g[5] == w[5] for g, w in zip(got, sorted(want, key=repr)) if g[0] in (9, 10, None)), "rows of one id keep their own spans"
    spans = {r[0]: r[5] for r in got}
    assert "forge" in spans[6], "held by one owner only"
    assert "bearer" not in spans[6] and "bearer" not in spans[7], "two owners hold it"
    base = {r[0]: r[5] for r in want}
    assert all(set(base[i].split(",")) <= set(spans[i].split(",")) | {""} for i in (1, 2, 3, 4, 5))


def test_secrets_judged_by_repositories_and_owners(make):
    """Documents 3k, 3k + 1 and 3k + 2 have different sources."""
    copied, pasted, several = "x Bearer copiedcopied00001234", "ghp_pastedpastedpasted12", "ghp_severalseveral123456"
    rows = [(1, copied), (2, copied), (3, copied)] + [(10 + 3 * i, f"text {i} {several}") for i in range(secrets.MAX_REPOS)]
    rows += [(100 + 3 * i, f"text {i} {pasted}") for i in range(secrets.MAX_REPOS + 1)]
    got = {r.doc_id: r for r in secrets.find_secrets(make(rows)).collect()}
    live = lambda i: (bool(got[i].spans), got[i].n_live, got[i].n_example)
    assert all(live(i) == (True, 1, 0) for i, _ in rows if i < 100), "copies of one text, or few repositories of one owner"
    assert all(live(i) == (False, 0, 1) for i, _ in rows if i >= 100), "pasted in many repositories of one owner"


def jaccard(docs, threshold=0.8):
    sets = {i: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in docs if i is not None}
    ids, root, n = sorted(sets), {i: i for i in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, find(i), n[i]) for i in ids), key=repr)


@pytest.mark.parametrize(("crowd", "block"), [(64, 256), (3, 256), (3, 4)])
def test_near_duplicates(make, corpus, crowd, block):
    rows = corpus[:-2]  # a repeated row is a copy of its document, which brute force has once; no row without an id
    assert rows_of(neardup.near_duplicates(make(rows, 3), crowd=crowd, block=block)) == jaccard([(i, words(t)) for i, t in rows])


def test_near_duplicates_of_repeated_rows(make, corpus):
    got = rows_of(neardup.near_duplicates(make(corpus)))
    assert len(got) == len(corpus) and [r for r in got if r[0] == 24] == [(24, 24, 1)] * 2


def test_near_duplicates_of_null_and_shared_ids(make):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a + " more"), (9, a), (None, c), (None, c), (5, a[:-3]), (5, b), (8, b), (None, None), (None, "")]
    got = rows_of(neardup.near_duplicates(make(rows)))
    assert got == sorted([(None, 5, 3), (None, 5, 3), (9, 5, 3), (5, 5, 3), (None, None, 1), (None, None, 1), (5, 5, 1), (8, 5, 1), (None, None, 0), (None, None, 0)], key=repr)
    assert rows_of(neardup.keep_first(make(rows)).select("doc_id", "text")) == sorted([(5, a[:-3]), (5, b), (None, c), (None, None), (None, "")], key=repr)
    classes = {(r.doc_id, r["class"]) for r in neardup.classes(make(rows)).filter("class is not null").collect()}
    assert len({k for _, k in classes}) == 3, "two classes of one smallest id stay two"


def test_matrix_overlaps():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    assert len(i) >= 1500
    assert neardup.overlaps(sets, i, j).tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j)]


def test_bayes_keeps_similar_pairs():
    least = neardup.least_matches(0.8)
    assert all(m <= 0.62 * n for m, n in zip(least, range(16, 129, 16))) and least[-1] > 50


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(60)]
    got = rows_of(connected_components(spark.createDataFrame(edges, "a long, b long"), f"file:///tmp/tidemark-test-{id(edges)}"))
    assert got == sorted([(2, 1), (3, 1), (4, 1), (8, 7), (9, 7)] + [(101 + i, 100) for i in range(60)], key=repr)


def test_quality_counts(make, corpus):
    rows = [*corpus, (80, "w # * 50% a&b <x>|y $5"), (81, "a b\n\n a b\na b\n \na b"), (82, "one two three four five six seven eight " * 4)]
    got = rows_of(quality.judge(make(rows), quality.Classifier()).select("doc_id", *quality.OUT, "base_failed", "kept"))
    want = []
    for i, t in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        covered = {k for p in range(len(w) - 7) if grams[tuple(w[p : p + 8])] > 1 for k in range(p, p + 8)}
        bad = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), bad, not bad))
    assert got == sorted(want, key=repr)


def test_quality_classifier(spark, make):
    import random

    r = random.Random(2)
    good = [" ".join(r.choice(["the", "house", "is", "near", "a", "river", "and", "we", "walk"]) for _ in range(60)) for _ in range(80)]
    bad = [" ".join(r.choice(["BUY!!", "$$$", "click", "NOW!!", "win", "%%%"]) + str(r.randint(0, 9)) for _ in range(60)) for _ in range(80)]
    docs = make([*enumerate(good), *enumerate(bad, 100)])
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(0, 80, 2), *range(100, 180, 2)]] + [(999, 1, 0), (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    assert all(got[i] for i in range(80)) and not any(got[100 + i] for i in range(80))
    assert quality.fit(docs, labels.limit(0)).weights is None
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == set(range(80))


def test_quality_learns_in_a_task(spark, make, monkeypatch):
    docs = make([(i, f"good calm words about river {i}" if i < 20 else f"CLICK $$$ now {i} %% win") for i in range(40)])
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "_descend", None)  # the driver's; tasks have their own
    model = quality.fit(docs, labels)
    monkeypatch.undo()
    assert model.weights.dtype == np.float32 and len(model.weights) == quality.DIM
    found = sorted(((r.doc_id, r.text) for r in docs.collect()))
    data = [(*x, int(i < 20)) for (i, _), x in zip(found, quality.features(quality.Words.of(pa.array([t for _, t in found]))), strict=True)]
    order = np.random.default_rng(7).permutation(40).tolist()
    assert np.array_equal(model.weights, quality._descend([data[i] for i in order[10:]]).astype(np.float32))


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "zeta, eta theta iota kappa lambda mu nu xi omicron pi"), (3, "short item"), (4, None), (5, "?!"), (6, "beta"), (7, "a a a a a a a a a a a"), (2, "second of one id here are ten words long it is"), (None, "without id"), ("", "without id"), (None, "one more of none")]


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_decontamination(make, spark, block_words):
    item = ITEMS[0][1]
    rows = [
        (1, f"x y {item} z"), (2, "ALPHA-beta/gamma delta epsilon zeta eta theta iota kappa"), (3, "a Short... ITEM b"), (4, None), (5, ""), (6, "nothing here"), (7, "a " * 25), (8, "a a a a a a a a a"),
        (9, "zeta eta theta iota kappa lambda mu nu xi omicron pi rho"), (10, "short short item item"), (11, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"), (12, "naïve short item short item"),
    ]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in ITEMS:
        w = norm(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[p : p + 10])].add(i if i is None else str(i))
    want = []
    for i, t in rows:
        w, hit, items = norm(t), set(), set()
        for p in range(len(w)):
            for n in range(1, 11):
                if p + n <= len(w) and (found := windows.get(tuple(w[p : p + n]))):
                    hit |= {*range(p, p + n)}
                    items |= found
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(x or "" for x in items)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame([(i if i is None else str(i), t) for i, t in ITEMS], "item_id string, text string")
    empty = bench.limit(0)
    got = rows_of(decontaminate.contamination(make(rows), bench, block_words=block_words).drop("item_ids"))
    assert got == sorted(want, key=repr)
    kept = {r.doc_id: r for r in decontaminate.decontaminate(make(rows), bench, block_words=block_words).collect()}
    clash = make(rows).withColumns({"_hit_words": F.lit(b"x"), "row": F.lit(1), "bits": F.lit(2), "Found": F.lit(3)})
    same = decontaminate.decontaminate(clash, bench, block_words=block_words)
    assert same.columns == clash.columns and {tuple(r)[-4:] for r in same.collect()} == {(b"x", 1, 2, 3)}
    assert 7 not in kept and kept[5].text == "" and kept[4].text is None
    assert kept[3].text == "a ... b".replace("...", "") or kept[3].text == "a  b"
    assert kept[3].n_chars == len(kept[3].text)


def test_language(make, spark):
    import random

    r = random.Random(1)
    sound = {"xx": ["the", "thing", "water", "with"], "yy": ["qué", "agua", "señor", "niño"], "zz": ["вода", "дом", "река"]}
    say = lambda k, n=30: " ".join(r.choice(sound[k]) for _ in range(n))
    learn = spark.createDataFrame([(i, say(k), k) for i, k in enumerate(list(sound) * 20)] + [(900, None, "xx"), (901, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(learn, 10)
    assert model.langs == sorted(sound)
    rows = [(1, say("xx")), (2, say("yy")), (3, say("zz")), (4, None), (5, ""), (6, "12 34 !! ² ½ Ⅷ _"), (7, say("xx", 40) + " " + say("zz", 20)), (8, "漢字"), (9, say("yy", 20000)), (9, say("yy", 5)), (None, say("zz"))]
    got = {r.doc_id: r for r in language.identify(make(rows), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7, 9, None)] == ["xx", "yy", "zz", "xx", "yy", "zz"]
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and got[8].lang_pred in sound
    assert [(s.start, s.end, s.lang) for s in got[7].spans] == [(0, 40, "xx"), (40, 60, "zz")] and 0 < got[7].score < 1
    assert language.identify(make(rows), language.fit(learn.limit(0))).filter("lang_pred <> 'und'").isEmpty()


def test_language_sample_and_many_languages(make, spark):
    rows = [(i, "abc", "xx" if i % 10 else "yy") for i in range(20_000)] + [(7, "abc", "xx")]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.xxhash64("doc_id", "text"))
    got = collections.Counter(r.lang for r in language.sample(known, 400).collect())
    assert got == {"xx": 400, "yy": 400}
    french = [(5, f"le texte {i}", "fr") for i in range(3000)] + [(i, "the text", "en") for i in range(390)] + [(2, "der Text", "de")] * 50
    few = spark.createDataFrame(french, "doc_id long, text string, lang string")
    hashed = few.withColumn("h", F.xxhash64("doc_id", "text"))
    assert collections.Counter(r.lang for r in language.sample(hashed, 400).collect()) == {"fr": 400, "en": 390, "de": 1}
    assert language.fit(few).langs == ["de", "en", "fr"], "many rows of one id, and repeated rows"
    import numpy as np

    scores = np.zeros((1, 300))
    scores[0, 299] = 1
    assert language.viterbi(scores, np.zeros(4, np.int64), np.array([0, 4])).tolist() == [299] * 4
    scores[0, 5] = 1
    assert language.viterbi(scores, np.zeros(4, np.int64), np.array([0, 4])).tolist() == [5] * 4, "ties go to the first"


def test_viterbi_is_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    scores, codes = rng.normal(size=(5, 3)) * 3, rng.integers(0, 5, 11)
    offsets = np.array([0, 6, 6, 11])
    path = language.viterbi(scores, codes, offsets, 2.0)
    value = lambda c, p: sum(scores[x, y] for x, y in zip(c, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    for a, b in ((0, 6), (6, 11)):
        best = max(value(codes[a:b], p) for p in itertools.product(range(3), repeat=b - a))
        assert value(codes[a:b], path[a:b]) == pytest.approx(best)


def test_empty_tables(make, spark):
    none, bench = make([]), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    from pyspark.sql import functions as F

    for df in (
        substrings.repeats(none), linededup.dedup_lines(none), secrets.find_secrets(none), neardup.near_duplicates(none), quality.judge(none, quality.fit(none, labels)),
        decontaminate.contamination(none, bench), language.identify(none, language.fit(none)), lm.score_texts(none, F.lit(False)),
    ):
        assert df.count() == 0
    assert decontaminate.contamination(make([(1, "a b")]), bench).first().n_hit == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
