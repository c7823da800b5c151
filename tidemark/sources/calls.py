"""Calls of paid services through a table of their answers, addressed by what was asked.

A question's key is a hash of the model, what else decides the answer, and the text. Of
equal questions one is asked, and none whose answer the table has. A task logs each answer
in the shared folder as soon as it has it; a task that runs again reads the log of its part
first and asks only what is open. When all tasks have ended, the answers are put into the
bucketed table and the run's logs go. Logs of a run that died stay, and the next run uses
them. Only two tasks that work on one part at the same moment can ask one thing twice.

A service that raises or gives None is asked again after a pause that doubles; a question
that stays without an answer is not stored, so the next run asks it anew.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_blank
from .bucketed import Table
from .providers import BATCH, BLANK, MAX_CHARS, Completer, Embedder
from .storage import delete, list_objects

#: Parts of the open questions; a task holds the logged answers of one part.
PARTS = 1024
ANSWERS = "key string, answer string"
Ask = Callable[[list[str]], list[str] | None]


def patient(ask: Ask, texts: list[str], tries: int, pause: float) -> list[str | None]:
    """The answers; after a failure again, with pauses of `pause`, twice that and so on. None for each if no try works."""
    for i in range(tries):
        try:
            found = ask(texts)
        except Exception:  # noqa: BLE001  whatever the service raises, it is asked again
            found = None
        if found is not None:
            return found
        if i + 1 < tries:
            time.sleep(pause * 2**i)
    return [None] * len(texts)


class Log:
    """The answers that tasks wrote for one part."""

    def __init__(self, root: str, part: int) -> None:
        self.fs, at = pafs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
        self.folder = f"{at}/{part:04d}"

    def read(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True)):
            if info.base_name.startswith("."):
                continue
            with self.fs.open_input_stream(info.path) as file:
                found |= json.loads(file.read())
        return found

    def write(self, run: str, answers: dict[str, str]) -> None:
        """A file appears under its name when it is whole."""
        name = f"{run}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        with self.fs.open_output_stream(f"{self.folder}/.{name}") as file:
            file.write(json.dumps(answers).encode())
        self.fs.move(f"{self.folder}/.{name}", f"{self.folder}/{name}")


class CallCache:
    """The answers of services below `root`, a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, tries: int = 3, pause: float = 1.0) -> None:
        self.spark, self.root, self.tries, self.pause = spark, root.rstrip("/"), tries, pause
        self.table = Table.create(spark, f"{self.root}/answers", spark.createDataFrame([], ANSWERS).schema, key="key")

    def answered(self, df: DataFrame, text: Column, ask: Ask, about: str, batch: int = 1) -> DataFrame:
        """The rows with `answer`: what `ask` gives for up to `batch` texts at a time; null text has none."""
        rows = df.withColumn("_text", text).withColumn("_key", F.when(F.col("_text").isNotNull(), F.sha2(F.concat(F.lit(f"{about}\n"), F.col("_text")), 256)))
        wanted = rows.filter("_key IS NOT NULL").groupBy(F.col("_key").alias("key")).agg(F.any_value("_text").alias("text"))
        open_ = wanted.join(self.table.read(), "key", "left_anti")
        parted = open_.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).repartition("part").sortWithinPartitions("part")
        run, logs, tries, pause = uuid.uuid4().hex, f"{self.root}/logs", self.tries, self.pause

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            log, known, now = None, {}, None
            for pdf in batches:
                for part, own in pdf.groupby("part"):
                    if part != now:
                        now, log = part, Log(logs, int(part))
                        known = log.read()
                    missing = [(k, t) for k, t in zip(own["key"], own["text"], strict=True) if k not in known]
                    for at in range(0, len(missing), batch):
                        keys, texts = zip(*missing[at : at + batch], strict=True)
                        got = {k: a for k, a in zip(keys, patient(ask, list(texts), tries, pause), strict=True) if a is not None}
                        if got:
                            log.write(run, got)
                        known |= got
                    some = [k for k in own["key"] if k in known]
                    yield pd.DataFrame({"key": some, "answer": [known[k] for k in some]}, dtype=object)

        self.table.upsert(parted.mapInPandas(work, ANSWERS))
        for path in list_objects(self.spark, logs):
            if path.rpartition("/")[2].startswith(run):
                delete(self.spark, path)
        return rows.join(self.table.read().withColumnRenamed("key", "_key"), "_key", "left").drop("_key", "_text")

    def forget_logs(self) -> None:
        """Remove all logs; only while no run is at work, whose answers would be asked for again."""
        delete(self.spark, f"{self.root}/logs")


def complete(df: DataFrame, provider: Completer, cache: CallCache, model: str, max_tokens: int = 2000) -> DataFrame:
    """The rows of prompts with `answer`, null where the service fails."""

    def ask(prompts: list[str]) -> list[str] | None:
        found = provider.complete(prompts[0], max_tokens)
        return None if found is None else [found]

    return cache.answered(df, F.col("prompt"), ask, f"complete {model} {max_tokens}")


def embed(df: DataFrame, text: Column, provider: Embedder, cache: CallCache, model: str, batch: int = BATCH) -> DataFrame:
    """The rows with `embedding` of the cut text, blank ones replaced; zero vectors where the service fails."""
    cut = non_blank(F.substring(F.coalesce(text, F.lit("")), 1, MAX_CHARS), BLANK)
    found = cache.answered(df, cut, lambda texts: [json.dumps(v) for v in provider.embed(texts)], f"embed {model} {provider.dim}", batch)
    vector = F.coalesce(F.from_json("answer", "array<float>"), F.array_repeat(F.lit(0.0).cast("float"), provider.dim))
    return found.withColumn("embedding", vector).drop("answer")
