"""Stage tables as JSON Lines or Parquet under a warehouse root, append-only by run."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import valid_json

#: Seconds after which the writer of a version file that is not whole is taken for dead.
DEAD_AFTER = 60.0


@dataclass(frozen=True)
class Settings:
    """Where data lies and which providers serve; from the environment, as TIDEMARK_ROOT and so on.

    A provider is "offline" or the URL of a service; `*_headers` are JSON objects of
    the headers it needs, `*_model` the model it is asked for.
    """

    root: str = "warehouse"
    search: str = "offline"
    search_headers: str = "{}"
    embedder: str = "offline"
    embedder_headers: str = "{}"
    embedder_model: str = ""
    llm: str = "offline"
    llm_headers: str = "{}"
    llm_model: str = ""
    #: Folder of the answers of services, for calls that ask nothing twice; none if blank.
    cache: str = ""

    @classmethod
    def from_env(cls) -> Settings:
        return cls(**{f: os.environ[f"TIDEMARK_{f.upper()}"] for f in cls.__dataclass_fields__ if f"TIDEMARK_{f.upper()}" in os.environ})


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all machines of a cluster share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to a fresh shared folder and read again, for what is used more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """All files whose path below the root starts with the prefix, sorted."""
    fs, at = _path(spark, root)
    if not fs.exists(at):
        return []
    base = fs.makeQualified(at).toString().rstrip("/") + "/"
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        name = files.next().getPath().toString()[len(base) :]
        if name.startswith(prefix) and not os.path.basename(name).startswith(("_", ".")):
            found.append(f"{base}{name}")
    return sorted(found)


def list_prefixes(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """Names of the child folders."""
    fs, at = _path(spark, f"{root}/{prefix}".rstrip("/"))
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; none where there is no file."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def create_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file where none is yet; whether it was free. The store's create must be atomic, as HDFS's or a local disk's."""
    fs, at = _path(spark, path)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception:
        if fs.exists(at):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


@dataclass(frozen=True)
class Version:
    """The newest whole version file of a folder, if any, and the number that the next one takes."""

    number: int
    body: dict | None
    next: int


def newest_version(spark: SparkSession, folder: str, dead_after: float = DEAD_AFTER) -> Version:
    """Files are named by their numbers and hold JSON objects.

    One that is not whole is being written, so its number is not free; after `dead_after`
    seconds its writer is taken for dead and the number is passed over.
    """
    passed = None
    for path in reversed(list_objects(spark, folder)):
        number, text = int(os.path.basename(path).partition(".")[0]), read_text(spark, path)
        try:
            return Version(number, json.loads(text or ""), number + 1 if passed is None else passed)
        except ValueError:
            fs, at = _path(spark, path)
            age = time.time() - fs.getFileStatus(at).getModificationTime() / 1000
            if age < dead_after or passed is None:
                passed = number if age < dead_after else number + 1
    return Version(0, None, 1 if passed is None else passed)


def read_lines(spark: SparkSession, root: str, prefix: str, schema: str) -> DataFrame:
    """JSON Lines files with a prefix as rows with `pos`, in file and line order.

    Blank and malformed lines are skipped; no file gives no rows. Files are ordered by
    their whole paths and split where Spark splits them. A line's place is the bytes of
    the files before, plus the offset of its split, plus the lines before it in the split,
    of which there are fewer than bytes; so places end where the bytes of all files do.
    """
    files = list_objects(spark, root, prefix)
    if not files:
        return spark.createDataFrame([], f"{schema}, pos bigint, file string")
    meta = {"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start"), "bytes": F.col("_metadata.file_size")}
    lines = spark.read.text(files).select("value", *(v.alias(k) for k, v in meta.items()), F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("file", "start", "bytes").agg(F.min("row").alias("first"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = splits.groupBy("file").agg(F.max("bytes").alias("bytes")).withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))  # one row for each file
    splits = splits.join(sizes.select("file", "base"), "file").select("file", "start", "first", "base")
    each = lines.filter((F.trim("value") != "") & valid_json("value")).join(splits, ["file", "start"])
    pos = F.col("base") + F.col("start") + F.col("row") - F.col("first")
    return each.select(F.from_json("value", schema).alias("r"), pos.alias("pos"), "file").select("r.*", "pos", "file")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON Lines file set; null fields are kept."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row; missing or malformed gives none."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    return text.filter(valid_json("value")).select(F.from_json("value", schema).alias("r")).select("r.*")


def write_document(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_stage(df: DataFrame, root: str, stage: str, sid: str, run: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append a run's rows to a stage table, which is partitioned by session and run."""
    df.withColumns({"sid": F.lit(sid), "run_ts": F.lit(run)}).write.mode("append").partitionBy("sid", "run_ts", *partition_by).parquet(f"{root}/{stage}")


def read_stage(spark: SparkSession, root: str, stage: str, sid: str, schema: str, snapshot: str = "all") -> DataFrame:
    """The rows of a session: of every run ("all"), or of the latest run only ("latest")."""
    fs, at = _path(spark, f"{root}/{stage}")
    if not fs.exists(at):
        return spark.createDataFrame([], f"{schema}, sid string, run_ts string")
    rows = spark.read.schema(f"{schema}, sid string, run_ts string").parquet(f"{root}/{stage}").filter(F.col("sid") == sid)
    return latest_run(rows) if snapshot == "latest" else rows


def latest_run(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("sid").agg(F.max("run_ts").alias("newest"))
    return rows.join(newest, "sid").filter(F.col("run_ts") == F.col("newest")).drop("newest")


def first_non_empty(*tables: DataFrame) -> DataFrame:
    """The first table that has a row, else the last."""
    return next((t for t in tables[:-1] if not t.isEmpty()), tables[-1])


def upsert(spark: SparkSession, old: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not in it; of equal keys in `new` the last `pos` wins."""
    if "pos" in new.columns:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pos")))).filter("_n = 1").drop("_n")
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
