import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import blocks, classify, terms, trees
from tidemark.sources.storage import stored

WORDS = ["apple", "bread", "cocoa", "dates", "endive", "figs"]


def sample(spark, n=600):
    """Two words of six a row, so that a feature has few values and every threshold between them is tried."""
    rng = np.random.default_rng(7)
    picked = [sorted(rng.choice(6, 2, replace=False).tolist()) for _ in range(n)]
    label = [int(rng.random() < (0.9 if 0 in p or p == [2, 3] else 0.2)) for p in picked]
    return spark.createDataFrame([(i, " ".join(WORDS[k] for k in p), "", str(y)) for i, (p, y) in enumerate(zip(picked, label, strict=True))], "pos int, title string, desc string, label string")


def made(spark):
    rows = stored(classify.texts(classify.normalise_labels(sample(spark)), F.col("y")), "texts")
    own, coded = terms.features(rows, 5000)
    return own, blocks.blocks(coded, 600, 3, own)


def test_fits_equal_those_of_mllib(spark):
    labeled = classify.normalise_labels(sample(spark))
    own, data = made(spark)
    vectors = own.transform(labeled).cache()
    dense = np.array([r.features.toArray() for r in vectors.orderBy("pos").collect()])
    p = lambda m: np.array([r.p for r in m.transform(vectors).orderBy("pos").select(vector_to_array("probability")[1].alias("p")).collect()])
    boosted = data.fit(trees.Boosting(8, 3, 0.1)).probability(dense)
    assert boosted == pytest.approx(p(GBTClassifier(labelCol="y", maxIter=8, maxDepth=3, stepSize=0.1, seed=42).fit(vectors)), abs=1e-6)
    linear = data.fit(classify.Regression(own.idf, 1 / 600), True).probability(dense)
    assert linear == pytest.approx(p(LogisticRegression(labelCol="y", maxIter=500, regParam=1 / 600, standardization=False).fit(vectors)), abs=1e-3)
    y = np.array([r.y for r in labeled.orderBy("pos").collect()])
    forest = data.fit(trees.Growing(40, 10, 1)).probability(dense)
    assert np.abs(forest - boosted).mean() < 0.15 and ((forest > 0.5) == y).mean() > 0.8
    vectors.unpersist()


def test_many_blocks_give_the_models_of_one_task(spark):
    own, data = made(spark)
    x = np.eye(len(own.names))
    for learner, whole in ((trees.Boosting(3, 3, 0.1), False), (trees.Growing(6, 4, 2), False), (classify.Regression(own.idf, 1 / 600), True)):
        one, many = (data.fit(learner, whole, limit).probability(x) for limit in (None, 0))
        assert one == pytest.approx(many, abs=1e-4 if whole else 0)


def test_a_fit_of_many_rounds_starts_few_jobs(spark):
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    model = classify.fit_ensemble(sample(spark), trees=10, rounds=60)
    assert jobs() - before < 60, "each round was some jobs"
    assert model.models["gbt"].trees.feature.shape == (60, 7) and model.models["rf"].trees.feature.shape == (10, 1023)


def test_terms_are_the_most_frequent(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" if k < 40 else "Été_9" for k in rng.zipf(1.5, 30)) + " x, É! W1-w2" for _ in range(80)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    n: Counter = Counter()
    for t in texts:
        w = re.findall(r"\w{2,}", (t or "").lower())
        n.update([(x,) for x in w])
        n.update(zip(w[:-1], w[1:], strict=True))
    for size in (10, 40, 10_000):
        want = sorted(n, key=lambda x: (-n[x], len(x), x))[:size]
        assert terms.most_frequent(rows, size) == [" ".join(x) for x in want]


def test_copies_of_a_text_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "COPIES", 20)
    rows = spark.createDataFrame([(5, i % 2, bytearray(b"\0\0"), bytearray(b"\1\0\0\0")) for i in range(90)], "h long, y int, term binary, times binary")
    data = blocks.blocks(rows, 90, 3, terms.Terms.of(["aa"], np.ones(1)))
    sizes = [len(r.y) for r in data.df.collect()]
    assert len(sizes) == 3 and sum(sizes) == 90 and data.values == 90


@pytest.mark.parametrize("label", ["1", "0"])
def test_one_label_and_no_words(spark, label):
    rows = spark.createDataFrame([("", None, label)] * 3 + [("a b", "c", label)] * 3, "title string, desc string, label string")
    scored = classify.fit_ensemble(rows, trees=3, rounds=2).score(rows).collect()
    assert len(scored) == 6 and all(r.is_relevant == (label == "1") for r in scored)
