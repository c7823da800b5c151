"""k-means of many models in one pass: all numbers of clusters and all starts advance together.

A model is a number of clusters and a start. One pass over the rows multiplies each Arrow
batch with the centres of all models at once and sums, for each centre, its rows; a task
sends one partial sum per centre. So a search over k with several starts takes as many
jobs as the slowest model takes steps, not a fit for each. The silhouettes of all k come
from one set of cluster sums and one more pass.

The driver holds the centres of all models and one row of sums for each, whose number the
parameters set; starts are drawn from `SAMPLE` rows, those with the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which starts are drawn, steps at most, and the largest move of a centre that still ends them.
SAMPLE, STEPS, TOLERANCE = 2000, 20, 1e-4
#: Rows for each task, and tasks at most.
ROWS_A_TASK, TASKS = 10_000, 4096


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def seeds(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the rows, each drawn by its squared distance to those before it."""
    chosen = [int(rng.integers(len(rows)))]
    far = ((rows - rows[chosen[0]]) ** 2).sum(1)
    for _ in range(1, min(k, len(rows))):
        total = far.sum()
        chosen.append(int(rng.choice(len(rows), p=far / total)) if total > 0 else int(rng.integers(len(rows))))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


@dataclass
class Models:
    """Centres of all models, one below the other, and where each model's begin."""

    centres: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, each: list[np.ndarray]) -> Models:
        return cls(np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]))

    def each(self) -> list[np.ndarray]:
        return [self.centres[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]

    def nearest(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each model the number of each row's centre among all, the first of equals, and its squared distance less the row's own square."""
        score = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            own = score[:, a:b].argmin(1)
            yield a + own, score[np.arange(len(x)), a + own]


@dataclass
class Sums:
    """Of each centre: rows, sum of the rows, of their squares, and of their squared distances to it."""

    n: np.ndarray
    x: np.ndarray
    squares: np.ndarray
    cost: np.ndarray


def sums(rows: DataFrame, models: Models) -> Sums:
    """One pass over rows (embedding)."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.centres)
        out = Sums(np.zeros(k), np.zeros(m.centres.shape), np.zeros(k), np.zeros(k))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            square = (x**2).sum(1)
            for own, score in m.nearest(x):
                order = np.argsort(own, kind="stable")
                at = np.flatnonzero(np.diff(own[order], prepend=-1))
                out.x[own[order][at]] += np.add.reduceat(x[order], at)
                out.n += np.bincount(own, minlength=k)
                out.squares += np.bincount(own, square, k)
                out.cost += np.bincount(own, np.maximum(0, score + square), k)
        some = np.flatnonzero(out.n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(out.n[some]), pa.array(out.squares[some]), pa.array(out.cost[some]), pa.array([v.tobytes() for v in out.x[some]], pa.binary())], names=["centre", "n", "squares", "cost", "x"])

    def add(table: pa.Table) -> pa.Table:
        x = np.sum([np.frombuffer(v.as_py(), np.float64) for v in table.column("x")], axis=0)
        whole = [float(np.sum(table.column(c).to_numpy())) for c in ("n", "squares", "cost")]
        return pa.table([table.column("centre").slice(0, 1), *(pa.array([v]) for v in whole), pa.array([x.tobytes()], pa.binary())], names=["centre", "n", "squares", "cost", "x"])

    schema = "centre int, n double, squares double, cost double, x binary"
    out = Sums(np.zeros(len(models.centres)), np.zeros(models.centres.shape), np.zeros(len(models.centres)), np.zeros(len(models.centres)))
    for r in rows.select("embedding").mapInArrow(run, schema).groupBy("centre").applyInArrow(add, schema).toLocalIterator():
        out.n[r["centre"]], out.squares[r["centre"]], out.cost[r["centre"]], out.x[r["centre"]] = r["n"], r["squares"], r["cost"], np.frombuffer(bytes(r["x"]), np.float64)
    shared.destroy()
    return out


def advanced(rows: DataFrame, models: list[np.ndarray], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The models after so many steps; one whose centres rest drops out of the passes. A centre without rows stays."""
    done, open_ = list(models), list(range(len(models)))
    for _ in range(steps):
        if not open_:
            break
        now = Models.of([done[i] for i in open_])
        found = sums(rows, now)
        moved = np.where(found.n[:, None] > 0, found.x / np.maximum(1, found.n)[:, None], now.centres)
        rest = []
        for i, a, b in zip(open_, now.starts[:-1].tolist(), now.starts[1:].tolist(), strict=True):
            if np.sqrt(((moved[a:b] - now.centres[a:b]) ** 2).sum(1)).max() > tolerance:
                rest.append(i)
            done[i] = moved[a:b]
        open_ = rest
    return done


def prepared(df: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(rows with an embedding in not too many tasks, a sample of them, their number)."""
    rows = df.filter("embedding IS NOT NULL").select("embedding")
    n = rows.count()
    some = rows.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).collect()
    sample = np.array([r["embedding"] for r in some], np.float64)
    return rows.coalesce(max(1, min(TASKS, n // ROWS_A_TASK))), sample, n


def fit(df: DataFrame, ks: list[int], n_init: int = 10, seed: int = 42, steps: int = STEPS) -> dict[int, np.ndarray]:
    """For each k the centres of the best of `n_init` starts by cost, the first of equals."""
    rows, sample, n = prepared(df)
    if not n:
        return {}
    asked = [(k, i) for k in ks for i in range(n_init)]
    rows = rows.cache()
    models = advanced(rows, [seeds(sample, k, np.random.default_rng([seed, k, i])) for k, i in asked], steps)
    every = Models.of(models)
    cost = np.add.reduceat(sums(rows, every).cost, every.starts[:-1])
    rows.unpersist()
    best = {k: min((i for i, (x, _) in enumerate(asked) if x == k), key=lambda i: (cost[i], i)) for k in ks}
    return {k: models[i] for k, i in best.items()}


def silhouettes(df: DataFrame, fitted: dict[int, np.ndarray]) -> dict[int, float]:
    """The mean silhouette of each model, by squared distances; a model with one cluster that has rows has none."""
    rows = df.filter("embedding IS NOT NULL").select("embedding")
    ks = list(fitted)
    if not ks:
        return {}
    models = Models.of([fitted[k] for k in ks])
    found = sums(rows, models)
    shared = rows.sparkSession.sparkContext.broadcast((models, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = shared.value
        total, n = np.zeros(len(m.starts) - 1), 0
        size = np.maximum(1, s.n)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            square, at = (x**2).sum(1), np.arange(len(x))
            n += len(x)
            mean = square[:, None] + s.squares / size - 2 * x @ (s.x / size[:, None]).T
            mean[:, s.n == 0] = np.inf
            for j, (own, _) in enumerate(m.nearest(x)):
                a, b = m.starts[j], m.starts[j + 1]
                inner = np.maximum(0, mean[at, own]) * size[own] / np.maximum(1, size[own] - 1)
                others = mean[:, a:b].copy()
                others[at, own - a] = np.inf
                outer = others.min(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    each = np.where(np.isinf(outer), np.nan, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300))
                total[j] += np.where(s.n[own] > 1, each, np.where(np.isinf(outer), np.nan, 0.0)).sum()
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], names=["model", "total", "n"])

    got = rows.mapInArrow(run, "model int, total double, n long").groupBy("model").agg((F.sum("total") / F.sum("n")).alias("s")).collect()
    return {ks[r["model"]]: r["s"] for r in got if r["s"] is not None and not np.isnan(r["s"])}


def choose_k(df: DataFrame, ks: list[int], n_init: int = 10, seed: int = 42) -> tuple[int | None, dict[int, float]]:
    """(the k with the best silhouette, the smallest of equals; all silhouettes)."""
    scores = silhouettes(df, fit(df, ks, n_init, seed)) if ks else {}
    best = None
    for k in sorted(scores):
        if scores[k] > (-1.0 if best is None else scores[best]):
            best = k
    return best, scores


def assigned(df: DataFrame, centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """The rows with the number of the nearest centre, null without an embedding."""
    shared = df.sparkSession.sparkContext.broadcast(Models.of([centres]))

    @F.pandas_udf("int")
    def number(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            some = s.notna().to_numpy()
            out = pd.Series(pd.array([None] * len(s), "Int32"), index=s.index)
            if some.any():
                own, _ = next(iter(shared.value.nearest(np.array(s[some].tolist(), np.float64))))
                out[some] = own
            yield out

    return df.withColumn(name, number(F.col("embedding").cast("array<double>")))
