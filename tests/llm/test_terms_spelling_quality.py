"""Source divergence, spelling variants and the quality classifier against brute force, on rows with every edge."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence, ftrl, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "doc_id long, text string, lang string, source string, term string, n long, value string, word string, y int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows, parts=3):
    """(doc_id, text, lang, source) rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "t", 1, "v", "w", 2) for r in rows], DDL).repartition(parts)


@pytest.fixture(scope="module")
def mixed_rows():
    r = random.Random(11)
    words = [a + b for a in ("ba", "Ko", "mi", "tü", "漢") for b in ("la", "ni", "ß", "pe")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(r.randint(1, 12)), "en" if i % 3 else "de", f"s{i % 4}" if i % 7 else None) for i in range(240)]
    rows += [(300, None, "en", "bare"), (301, "", "fr", "s0"), (302, None, "fr", "s1"), (303, "few words", None, None), (304, "12 !!", "en", "é"), (None, say(5), "en", "s1")]
    rows += [(305, "la-" * 20_000, "en", "s2"), (306, "x" * 5000, "de", "Z")]
    return rows + rows[:40]  # repeated rows


def audited(rows, least):
    """The contract in plain Python with whole numbers."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        having = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in having.items() if n >= least), key=str.encode)
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), collections.Counter()))
        for s in count:
            pairs = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in count if x != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 50)):
                out += [(lang, s, part, x, v, k) for k, (v, x) in enumerate(sorted(found, key=lambda y: (-y[0], y[1].encode()))[:most], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rows", "terms", "sources"), [(250_000, 4096, 128), (7, 3, 2)])
def test_divergence(spark, mixed_rows, rows, terms, sources):
    """At any size of buckets, chunks and blocks."""
    found = divergence.divergence(table(spark, mixed_rows), 12, rows, terms, sources)
    assert rows_of(found) == audited(mixed_rows, 12)


def test_divergence_equals_sql(spark, mixed_rows):
    rows = mixed_rows * 3
    con = duckdb.connect()
    con.register("documents", table(spark, rows).toPandas())
    want = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE_SQL})").fetchall()
    assert rows_of(divergence.divergence(table(spark, rows))) == sorted(want, key=repr) == audited(rows, 30)
    assert divergence.divergence(table(spark, mixed_rows).limit(0)).count() == 0


def test_shares_are_exact():
    r = random.Random(2)
    over = [r.randrange(1, 2**53) for _ in range(300)] + [1, 2**53 - 1]
    count = [r.randrange(0, n + 1) for n in over]
    got = divergence.shares(np.array(count), np.array(over)).tolist()
    assert got == [1 + 10**9 * c // n for c, n in zip(count, over)]
    with pytest.raises(ValueError, match="words"):
        divergence.shares(np.array([1]), np.array([2**53]))


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def spelled(rows):
    n = collections.Counter()
    for i, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n = {w: x for w, x in n.items() if len(w) >= 5 and x >= 3}
    near = {w: [x for x in n if edits(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


@pytest.fixture(scope="module")
def variants():
    r = random.Random(7)
    letters = "abeéÿÀ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "aabaab", "x" * 4000, "x" * 3999]
    out = []
    for i in range(500):
        line = []
        for _ in range(25):
            w = base[min(int(r.expovariate(0.12)), len(base) - 1)]
            if r.random() < 0.3:
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + r.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k + 1 :]])
            line.append(w.upper() if r.random() < 0.1 and w.isascii() else w)
        out.append((i, r.choice([" ", "-", "1", "ā", "Ā", "漢"]).join(line), "en", "s"))
    return out + [(None, "aaaaa aaaaab " * 9, "", ""), (600, None, "", ""), (601, "", "", ""), *out[:30]]


@pytest.mark.parametrize("hot_share", [0.001, 0.0005])
def test_spelling_variants(spark, variants, tmp_path, hot_share):
    want = spelled(variants)
    assert len(want) > 150 and any(r[1] and r[1] != r[2] for r in want), "words that lead on"
    got = rows_of(spelling.variants(table(spark, variants), hot_share))
    assert got == want


def test_spelling_of_an_empty_table(spark):
    assert spelling.variants(table(spark, [(1, "a", "", "")]).limit(0)).count() == 0
    assert spelling.variants(table(spark, [(1, None, "", ""), (2, "word word", "", "")])).count() == 0


def test_three_rarest_bigrams_find_every_neighbour():
    """For any order of the bigrams, the entries of two near words meet."""
    r = random.Random(1)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(5, 9)))
        k, c = r.randrange(len(a)), r.choice("abc")
        b = r.choice([a[:k] + c + a[k:], a[:k] + c + a[k + 1 :]])
        if not edits(a, b):
            continue
        order = {g: r.random() for g in (x + y for x in "abc" for y in "abc")}
        first = lambda w: sorted((order[w[i : i + 2]], i, w[i : i + 2]) for i in range(len(w) - 1))[:3]  # noqa: E731, B023
        short, long = sorted((a, b), key=len)
        shift = len(long) - len(short)
        assert any(g == h and q - p in (0, shift) for _, p, g in first(short) for _, q, h in first(long))


def good_and_bad(r, n):
    syllables = [a + b for a in "bdklmnprst" for b in ("a", "e", "io", "un")]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    good = lambda: " ".join(word() for _ in range(r.randint(30, 80))).capitalize() + "."
    bad = [lambda: " ".join(word().upper() + "!!" for _ in range(40)), lambda: " | ".join(word() for _ in range(40)), lambda: (word() + " ") * 60, lambda: " ".join(word() + r.choice(["$$$", "&&&"]) for _ in range(50))]
    return [(good(), 1) for _ in range(n)] + [(r.choice(bad)(), 0) for _ in range(n // 4)]


def test_quality_classifier_on_held_out_rows(spark):
    r = random.Random(5)
    rows = good_and_bad(r, 400)
    r.shuffle(rows)
    docs = table(spark, [(i, t, "en", "s") for i, (t, _) in enumerate(rows)] + [(900, None, "", ""), (901, "", "", ""), (902, "ok " * 200_000, "", ""), (None, rows[0][0], "", ""), (0, rows[0][0], "", "")])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if i % 3] + [(7, 0), (None, 1), (4, None), (99999, 0)], "doc_id long, quality int")
    model = ftrl.fit(docs, labels)
    got = {x.doc_id: x for x in ftrl.score(docs, model).collect()}
    held = [(got[i], y) for i, (_, y) in enumerate(rows) if i % 3 == 0]
    assert sum(x.predicted == y for x, y in held) >= 0.98 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values()) and ftrl.score(docs, model).count() == len(rows) + 5
    assert got[900].score == got[901].score and got[None].score == got[0].score, "one text has one score"
    again = ftrl.fit(docs.repartition(7), labels.repartition(2))
    assert np.array_equal(again.weights, model.weights) and (again.slope, again.offset) == (model.slope, model.offset)
    few = ftrl.fit(docs, labels, rows=50)
    assert np.count_nonzero(few.weights) < np.count_nonzero(model.weights)


def test_quality_without_labels(spark):
    docs = table(spark, [(1, "a b", "", ""), (2, None, "", "")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.score for x in ftrl.score(docs, ftrl.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(x.score > 0.5 for x in ftrl.score(docs, ftrl.fit(docs, one)).collect())
    assert ftrl.score(docs.limit(0), ftrl.fit(docs.limit(0), one)).count() == 0


def test_leader_follows_the_sum_of_all_slopes():
    """The lazy update equals the arg min over all slopes and steps so far, coordinate by coordinate."""
    r = np.random.default_rng(3)
    leader = ftrl.Leader(6, 0.3, 1.0, 0.2, 0.5)
    slopes, steps, n = np.zeros(6), [], np.zeros(6)
    for _ in range(40):
        index, y = np.sort(r.choice(6, 3, replace=False)), int(r.integers(2))
        value = r.normal(size=3)
        w = leader.weights()
        g = np.zeros(6)
        g[index] = (1 / (1 + np.exp(-w[index] @ value)) - y) * value
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / 0.3
        slopes, n = slopes + g, n + g * g
        steps.append((sigma, w))
        leader.learn(index, value, y)
        for k in range(6):
            grid = np.linspace(-2, 2, 40_001)
            cost = slopes[k] * grid + sum(s[k] / 2 * (grid - x[k]) ** 2 for s, x in steps) + 0.2 * np.abs(grid) + (0.5 + 1 / 0.3) / 2 * grid**2
            assert abs(grid[cost.argmin()] - leader.weights()[k]) < 2e-4


def test_features_are_shares_of_grams():
    offsets, index, value = ftrl.features(pa.array(["A b a b", "", "one", "x x x x x x"]))
    assert offsets[2] == offsets[1] and (np.diff(offsets) > 0).tolist() == [True, False, True, True]
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        assert hi == lo or value[lo:hi].sum() == pytest.approx(np.sqrt(hi - lo), rel=1e-5)
    assert ftrl.shapes(pa.array(["Abc12!", "ÉÀ", "çé", "x9"])).to_pylist() == ["Xx9!", "X", "x", "x9"]
