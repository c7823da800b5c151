"""Structured Streaming forms of the crawl's dedup, batching and job states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators.jobs import STATUSES, TIMEOUT_HOURS


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup_links(posts: DataFrame, ts: str = "ts", within: str = "1 day") -> DataFrame:
    """The first post of each link that comes within the watermark; state is dropped behind it."""
    return posts.withWatermark(ts, within).dropDuplicatesWithinWatermark(["link"])


def progress_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and mean progress of each job type in tumbling windows."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "job_type")
    return by.agg(F.count("*").alias("n"), F.avg("progress").alias("progress")).select(F.col("window.start").alias("start"), "job_type", "n", "progress")


def job_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Bursts of a session's events that lie less than `gap` apart."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "sid")
    return by.agg(F.count("*").alias("n")).select("sid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 500, mode: str = "append") -> StreamingQuery:
    """Write all that is there to Parquet files of at most so many rows, then stop."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file).trigger(availableNow=True).format("parquet").start(path)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class JobStates(StatefulProcessor):
    """A job's state with its guards, its timeout as a timer, and its running total.

    The state is (time in ms, running, total). Events at or before the time of the state
    are late or repeated and change nothing; the others follow `jobs.transitions`.
    """

    def __init__(self, hours: int) -> None:
        self.timeout = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "ts long, running boolean, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        at, running, total = self.state.get() if self.state.exists() else (-1, False, 0)
        every = pd.concat(list(rows))
        every = every[every["status"].isin(STATUSES)]
        every = every.assign(k=every["status"].map(STATUSES.index), ms=every["ts"].astype("datetime64[ms]").astype("int64")).sort_values(["ms", "k"]).drop_duplicates("ms")
        out = []
        for ms, status, n in zip(every["ms"].tolist(), every["status"].tolist(), every["n"].tolist(), strict=True):
            if ms <= at:
                continue
            total += int(n)
            if running and ms > at + self.timeout:
                out.append((at + self.timeout, "timeout", total - int(n)))
                running = False
            if status == "running" or running:
                out.append((ms, status, total))
            running, at = status == "running", ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if running:
            self.handle.registerTimer(at + self.timeout + 1)
        self.state.update((at, running, total))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, running, total = self.state.get()
        self.state.update((at, False, total))
        yield self._rows(key, [(at + self.timeout, "timeout", total)] if running else [])

    def _rows(self, key, found: list[tuple[int, str, int]]) -> pd.DataFrame:
        ts = pd.to_datetime(pd.Series([r[0] for r in found], dtype="int64"), unit="ms")
        return pd.DataFrame({"sid": pd.Series([key[0]] * len(found), dtype="object"), "job_type": pd.Series([key[1]] * len(found), dtype="object"), "ts": ts, "status": pd.Series([r[1] for r in found], dtype="object"), "total": pd.Series([r[2] for r in found], dtype="int64")})

    def close(self) -> None:
        """Nothing is open."""


#: The state store that job states need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_states(events: DataFrame, hours: int = TIMEOUT_HOURS, late: str = "1 hour") -> DataFrame:
    """sid, job_type, ts, status, total: the accepted changes of events (sid, job_type, ts, status, n), with timeouts and the running total of n.

    spark.sql.streaming.stateStore.providerClass has to be `STATE_STORE`. State is kept
    for each job; events behind the watermark are dropped.
    """
    rows = events.select("sid", "job_type", "ts", "status", F.col("n").cast("long")).withWatermark("ts", late)
    return rows.groupBy("sid", "job_type").transformWithStateInPandas(JobStates(hours), "sid string, job_type string, ts timestamp, status string, total long", "append", "EventTime")


def latest_jobs_stream(events: DataFrame) -> DataFrame:
    """The newest state of each job, updated as events come (complete or update mode)."""
    return events.groupBy("sid", "job_type").agg(F.max(F.struct("ts", "progress")).alias("r")).select("sid", "job_type", "r.*")
