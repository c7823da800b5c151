"""Relevance: labels, features, three models, a soft vote."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import ensemble_mean, is_relevant_label, round3
from ..functions.text import dflt, head, parse_binary_preds, post_text
from ..sources.providers import Completer, complete
from ..sources.storage import scratch, stored
from .blocks import Blocks, blocks
from .kmeans import ROWS_A_TASK
from .logistic import Regression
from .posts import numbered, with_batch
from .terms import Terms, features, steps, unpacked
from .trees import Boosting, Growing

LEAST_LABELS, THRESHOLD, MAX_FEATURES = 5, 0.5, 5000
#: Fits that run at once.
AT_ONCE = 4
#: Blocks of a fit whose rows would fill fewer, if each has this many.
FIT_TASKS, LEAST_ROWS = 12, 1000
#: Rows of a step of scoring, which holds all their features.
STEP = 128
MODELS = ("lr", "rf", "gbt")


def normalise_labels(df: DataFrame) -> DataFrame:
    """The rows with `y`; fewer than five raise."""
    rows = df.withColumn("y", is_relevant_label("label"))
    if rows.limit(LEAST_LABELS).count() < LEAST_LABELS:
        raise ValueError(f"at least {LEAST_LABELS} labelled rows are needed")
    return rows


def texts(rows: DataFrame, y: Column) -> DataFrame:
    """h, y, text: a hash of the post, its label, title and description."""
    return rows.select(F.xxhash64("title", "desc").alias("h"), y.alias("y"), post_text().alias("text"))


def fit_features(rows: DataFrame, max_features: int = MAX_FEATURES) -> Terms:
    """TF-IDF of words and pairs: idf ln((1 + n) / (1 + df)) + 1, rows scaled to length 1."""
    return features(stored(texts(rows, F.lit(0)), "texts"), max_features)[0]


def estimators(idf: np.ndarray, n: int, trees: int = 100, rounds: int = 100, seed: int = 42) -> dict:
    return {"lr": Regression(idf, 1 / max(1, n), 500), "rf": Growing(trees, 10, seed), "gbt": Boosting(rounds, 3, 0.1)}


def detached(name: str, model: Any, folder: str) -> Any:
    """A fitted model written to a shared folder and read again; it holds numbers only, no session."""
    spark = SparkSession.builder.getOrCreate()
    spark.createDataFrame([(name, bytearray(pickle.dumps(model)))], "name string, model binary").coalesce(1).write.parquet(folder)
    return pickle.loads(spark.read.parquet(folder).first()["model"])


def probabilities(terms: Terms, models: dict, row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Each model's probability for n rows, of which some features are given by row."""
    x, _ = terms.weights(row, term, times, n)
    out = {m: np.zeros(n) for m in models}
    for at in range(0, n, STEP):
        own = slice(*np.searchsorted(row, [at, at + STEP]))
        dense = np.zeros((min(STEP, n - at), max(1, len(terms.names))))
        dense[row[own] - at, term[own]] = x[own]
        for name, model in models.items():
            out[name][at : at + STEP] = model.probability(dense[:, : len(terms.names)] if name == "lr" else dense)
    return out


@dataclass
class Ensemble:
    features: Terms
    models: dict
    judged: Callable[[], dict]

    @cached_property
    def accuracy(self) -> dict:
        """The mean accuracy of each model over the folds, whose fits begin when it is asked for; scores do not need them."""
        return self.judged()

    def score(self, posts: DataFrame) -> DataFrame:
        """The posts with relevance_score and is_relevant."""
        terms, models = self.features, self.models

        def run(column: pa.Array) -> pa.Array:
            each = [probabilities(terms, models, *terms.counts(part), len(part)) for part in steps(column)]
            return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *(p[m] for p in each)])) for m in models], names=list(models))

        p = F.arrow_udf(run, ", ".join(f"{m} double" for m in models))
        rows = posts.withColumn("_p", p(post_text()))
        return ensemble(rows.select(*posts.columns, *(F.col(f"_p.{m}").alias(f"p{i}") for i, m in enumerate(models))), [f"p{i}" for i in range(len(models))])

    def cv_scores(self) -> DataFrame:
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame(list(self.accuracy.items()), "model string, accuracy double").select("model", round3("accuracy").alias("accuracy"))


def ensemble(df: DataFrame, p_cols: list[str]) -> DataFrame:
    """The mean of the models' probabilities, and whether it reaches one half; the inputs are dropped."""
    scored = df.withColumn("relevance_score", ensemble_mean(*p_cols)).drop(*p_cols)
    return scored.withColumn("is_relevant", F.col("relevance_score") >= THRESHOLD)


def fit_tasks(n: int) -> int:
    """Blocks of a fit over n rows: as many as share its work, up to a number that small ones take, and more for many rows."""
    return max(1, n // ROWS_A_TASK, min(FIT_TASKS, n // LEAST_ROWS))


def with_folds(data: DataFrame, k: int) -> DataFrame:
    """The rows with `fold`: in the order of a hash, each label's rows take the folds in turn."""
    each = [numbered(data.filter(F.col("y") == y), "_h", "_n") for y in (0, 1)]
    return each[0].union(each[1]).withColumn("fold", F.pmod(F.col("_n"), F.lit(max(1, k))).cast("int")).drop("_n", "_h")


def right(rows: DataFrame, terms: Terms, models: dict) -> dict[str, float]:
    """The share of encoded rows whose label each model says."""

    def run(batches):
        n, hits = 0, np.zeros(len(models), np.int64)
        for batch in batches:
            term, times = unpacked(batch.column("term"), np.uint16), unpacked(batch.column("times"), np.uint32)
            row, y = np.repeat(np.arange(batch.num_rows), [len(x.as_buffer()) // 2 for x in batch.column("term")]), batch.column("y").to_numpy()
            p = probabilities(terms, models, row, term.astype(np.int64), times, batch.num_rows)
            n, hits = n + batch.num_rows, hits + [int(((p[m] > THRESHOLD) == (y == 1)).sum()) for m in models]
        yield pa.record_batch([pa.array([n]), *(pa.array([h]) for h in hits)], names=["n", *models])

    schema = ", ".join(f"{c} long" for c in ("n", *models))
    total = rows.select("y", "term", "times").mapInArrow(run, schema).agg(*(F.sum(c).alias(c) for c in ("n", *models))).first()
    return {m: total[m] / total["n"] for m in models}


def fit_ensemble(labeled: DataFrame, seed: int = 42, folds: int = 3, trees: int = 100, rounds: int = 100) -> Ensemble:
    """Fit on labelled posts (title, desc, label); `folds` of stratified accuracy are fitted when they are asked for.

    The fits do not depend on each other and run at once, on blocks that are stored once.
    """
    terms, rows = features(stored(texts(normalise_labels(labeled), F.col("y")), "texts"), MAX_FEATURES)
    n = rows.count()
    k, folder = min(folds, n), scratch(labeled.sparkSession, "models")

    def fitted(some: DataFrame, n: int, end: str = "") -> dict:
        data: Blocks = blocks(some, n, fit_tasks(n), terms)
        kinds = estimators(terms.idf, n, trees, rounds, seed)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            made = dict(zip(kinds, pool.map(lambda m: detached(m, data.fit(kinds[m], m == "lr"), f"{folder}/{m}{end}"), kinds), strict=True))
        return {m: made[m] for m in MODELS}

    def judged() -> dict:
        scores: dict = {m: [] for m in MODELS}
        data = stored(with_folds(rows.withColumn("_h", F.col("h")), k), "folds") if k > 1 else None
        for i in range(k if k > 1 else 0):
            train, test = data.filter(F.col("fold") != i), data.filter(F.col("fold") == i)
            if train.select("y").distinct().count() == 2 and not test.isEmpty():
                for m, share in right(test, terms, fitted(train, train.count(), f"-{i}")).items():
                    scores[m].append(share)
        return {m: sum(x) / len(x) if x else float("nan") for m, x in scores.items()}

    return Ensemble(terms, fitted(rows, n), judged)


def counters(scored: DataFrame) -> DataFrame:
    """total, relevant, irrelevant: numbers of scored posts."""
    return scored.agg(F.count("*").alias("total"), F.count_if("is_relevant").alias("relevant"), F.count_if(~F.col("is_relevant")).alias("irrelevant"))


BATCH_PROMPT = "Product: {bk}\nProblem: {problem}\nSay of each post whether it is about the product, as 1 or 0 in order, with commas.\n{posts}"


def batch_prompts(posts: DataFrame, bk: str, problem: str, size: int = 20) -> DataFrame:
    """batch, n, prompt: the posts in batches of `size`, each line with the title and the description's first 100 characters."""
    line = F.concat(dflt("title", ""), F.lit(" - "), head("desc", 100))
    rows = with_batch(posts.select("pos", line.alias("line")), size)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"]))
    each = rows.groupBy("batch").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("posts"))
    text = F.replace(F.replace(F.replace(F.lit(BATCH_PROMPT), F.lit("{bk}"), F.lit(bk)), F.lit("{problem}"), F.lit(problem)), F.lit("{posts}"), F.col("posts"))
    return each.select("batch", "n", text.alias("prompt"))


def answered_labels(posts: DataFrame, bk: str, problem: str, provider: Completer | None = None, size: int = 20) -> DataFrame:
    """pos, label: the service's 0 or 1 for each post; posts without an answer have 0."""
    answers = complete(batch_prompts(posts, bk, problem, size), provider, 1000)
    each = answers.select("batch", F.posexplode(parse_binary_preds("answer", F.col("n"))).alias("i", "label"))
    rows = with_batch(posts.select("pos"), size)
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy("batch").orderBy("pos")) - 1)
    return placed.join(each, ["batch", "i"]).select("pos", "label")


#: Characters that part words for token ids (fixed values), words with ids, and ids a text.
FILTERED = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
VOCABULARY, LENGTH, OOV = 10_000, 200, 1


def sequence_words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(text), FILTERED, " " * len(FILTERED)), " "), lambda w: w != "")


def word_ids(posts: DataFrame, n_words: int = VOCABULARY) -> DataFrame:
    """word, id: the most frequent words from 2 on, equal ones in the order they are first seen; ids stay below `n_words`."""
    words = posts.select("pos", F.posexplode(sequence_words(post_text())).alias("place", "word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("pos", "place")).alias("first"))
    top = counted.orderBy(F.desc("n"), "first").limit(n_words - OOV - 1)
    return top.select("word", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) + OOV).alias("id"))  # a bounded vocabulary


def token_ids(posts: DataFrame, ids: DataFrame, length: int = LENGTH) -> DataFrame:
    """pos, ids: each text's first `length` words as ids, 1 for a word without one, padded with 0 at the end."""
    texts = posts.select("pos", F.slice(sequence_words(post_text()), 1, length).alias("w"))
    words = texts.select("pos", F.posexplode("w").alias("place", "word")).join(F.broadcast(ids), "word", "left")
    found = words.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("id", F.lit(OOV)).alias("id")))), lambda x: x["id"]).alias("ids"))
    own = F.coalesce("ids", F.array().cast("array<int>"))
    return texts.select("pos").join(found, "pos", "left").select("pos", F.concat(own, F.array_repeat(F.lit(0), F.lit(length) - F.size(own))).alias("ids"))


def split(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relevant rows, other rows without a score)."""
    return scored.filter("is_relevant").drop("is_relevant"), scored.filter("NOT is_relevant").drop("is_relevant", "relevance_score")


__all__ = ["Ensemble", "ensemble", "fit_ensemble", "normalise_labels", "post_text", "split"]
