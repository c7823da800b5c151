"""Job states and sessions, always derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import JOB_TYPES


def latest_by(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newest row of each key, by one aggregation; ties go to the largest row."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(ts, *(c for c in rest if c != ts))
    return df.groupBy(*keys).agg(F.max(ordered).alias("_r")).select(*keys, "_r.*")


def pipeline_status(events: DataFrame, sessions: DataFrame | None = None, types: list[str] = JOB_TYPES) -> DataFrame:
    """One row for each session, one column with the latest progress of each job type."""
    newest = latest_by(events.select("sid", "job_type", "ts", "progress"), ["sid", "job_type"], "ts")
    wide = newest.groupBy("sid").pivot("job_type", types).agg(F.first("progress"))
    return wide if sessions is None else wide.join(sessions, "sid", "full")


#: Hours after which a running job that says nothing more has failed, and statuses in the order in which they hold at one time.
TIMEOUT_HOURS = 6
STATUSES = ("running", "done", "error")


def transitions(events: DataFrame, hours: int = TIMEOUT_HOURS) -> DataFrame:
    """sid, job_type, ts, status: the changes of state that events (sid, job_type, ts, status) lead to.

    A job starts to run from any state; it ends, as done or error, only while it runs. One
    that runs for more than `hours` without an event has a timeout, after which it does
    not run. Repeated events count once; of several at one time the first status of
    `STATUSES` holds. A timeout is known once a later event of its job shows the time.
    """
    order = sum((F.when(F.col("status") == s, i).otherwise(0) for i, s in enumerate(STATUSES)), F.lit(0))
    once = events.filter(F.col("status").isin(*STATUSES)).groupBy("sid", "job_type", "ts").agg(F.min(order).alias("k"))
    w = Window.partitionBy("sid", "job_type").orderBy("ts")
    rows = once.withColumns({"before": F.lag("k").over(w), "since": F.lag("ts").over(w), "after": F.lead("ts").over(w)})
    late = F.make_interval(hours=F.lit(hours))
    status = F.get(F.array(*(F.lit(s) for s in STATUSES)), F.col("k"))
    accepted = rows.filter((F.col("k") == 0) | ((F.col("before") == 0) & (F.col("ts") <= F.col("since") + late))).select("sid", "job_type", "ts", status.alias("status"))
    failed = rows.filter((F.col("k") == 0) & (F.col("after") > F.col("ts") + late)).select("sid", "job_type", (F.col("ts") + late).alias("ts"), F.lit("timeout"))
    return accepted.union(failed)


def session_list(prefixes: DataFrame, sessions: DataFrame, limit: int = 20) -> DataFrame:
    """sid, bk, step of the newest sessions; blanks where there is no document."""
    return prefixes.join(sessions, "sid", "left").select("sid", F.coalesce("bk", F.lit("")).alias("bk"), F.coalesce("step", F.lit("")).alias("step")).orderBy(F.desc("sid")).limit(limit)


def insights_state(personas: DataFrame, info: DataFrame) -> str:
    """What the insights can show: 'graph', 'clusters' or 'running'."""
    if not personas.isEmpty():
        return "graph"
    return "clusters" if not info.isEmpty() else "running"
