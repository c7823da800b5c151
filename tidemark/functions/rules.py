"""Column expressions of the pipeline's numeric and label rules."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores by least total, pipeline steps by stage.
SCORES = [(10000, 95), (5000, 85), (1000, 75), (500, 65), (100, 55), (50, 45), (10, 35)]
LOWEST_SCORE, FAILED_SCORE = 25, 50
STEPS = {
    "start": 0, "r1": 1, "r2": 1, "r3": 1, "r3-expand": 1, "final": 1, "crawl-setup": 2, "crawl-start": 2,
    "preprocess-setup": 3, "preprocess-start": 3, "labeling": 4, "labeling-done": 4, "train-start": 5, "train-check": 5,
    "clustering": 6, "cluster-start": 6, "cluster-check": 6, "cluster-refine": 6, "persona": 7, "persona-start": 7,
    "persona-check": 7, "embed-start": 7, "embed-check": 7, "done": 7,
}
EXPAND_BELOW = 160


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def score_of_total(total: Column | str) -> Column:
    """A search total as a score; a failed lookup (null) scores 50."""
    total = _c(total)
    out = F.when(total.isNull(), FAILED_SCORE)
    for least, score in SCORES:
        out = out.when(total >= least, score)
    return out.otherwise(LOWEST_SCORE)


def score_band(score: Column | str) -> Column:
    return F.when(_c(score) >= 70, "high").when(_c(score) >= 50, "medium").otherwise("low")


def index_name(sid: Column | str) -> Column:
    return F.substring(F.concat(F.lit("cx-"), F.lower(F.translate(_c(sid), "_", "-"))), 1, 45)


def node_size(n: Column | str) -> Column:
    return F.least(F.lit(30).cast("long"), F.lit(15) + F.floor(_c(n) / 100)).cast("long")


def progress(done: Column | str, total: Column | str) -> Column:
    return F.lit(20) + F.floor(F.lit(70) * _c(done) / _c(total))


def session_id(ts: Column | str) -> Column:
    return F.concat(F.lit("s"), F.unix_millis(_c(ts)))


def step_index(step: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, _c(step)), F.lit(0))


def label_pct(done: Column | str, total: Column | str) -> Column:
    goal = F.ceil(_c(total) * F.lit(0.02))
    return F.when(goal > 0, F.least(F.lit(100).cast("long"), F.floor(_c(done) * 100 / goal + F.lit(0.5)).cast("long"))).otherwise(F.lit(0).cast("long"))


def short_name(name: Column | str) -> Column:
    return F.when(F.length(_c(name)) > 8, F.concat(F.substring(_c(name), 1, 8), F.lit("..."))).otherwise(_c(name))


def persona_quota(size: Column | str) -> Column:
    return F.when(_c(size) < 50, 1).when(_c(size) < 200, 2).otherwise(3)


def round_number(name: Column | str) -> Column:
    return F.when(_c(name) == "r1", 1).when(_c(name) == "r2", 2).when(_c(name) == "r3", 3).otherwise(4)


def next_round(name: Column | str, n_keywords: Column | str) -> Column:
    name = _c(name)
    return F.when(name == "r1", "r2").when(name == "r2", "r3").when((name == "r3") & (_c(n_keywords) < EXPAND_BELOW), "r3-expand").otherwise("final")


def is_nonzero(v: Column | str) -> Column:
    return F.exists(_c(v), lambda x: x != 0)


def ensemble_mean(*p: Column | str) -> Column:
    return sum((_c(x) for x in p[1:]), _c(p[0])) / len(p)


def round3(c: Column | str) -> Column:
    """Half to even, at 3 decimals."""
    return F.bround(_c(c), 3)


def target_desc(*groups: Column | str, everyone: str = "everyone") -> Column:
    """Non-empty groups joined by ' | ', or the word for everyone."""
    joined = F.concat_ws(" | ", *(F.nullif(F.array_join(_c(g), ", "), F.lit("")) for g in groups))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(everyone))


def is_relevant_label(label: Column | str) -> Column:
    """1 for "relevant" or the JSON number 1, else 0; the JSON type matters, so "1" is 0.

    `label` is the JSON text of the value (1, "1", "relevant").
    """
    return F.when(_c(label).isin('"relevant"', "1", "1.0"), 1).otherwise(0)


def run_ts(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def default_window(today: date) -> tuple[str, str]:
    return str(today - timedelta(days=365)), str(today)
