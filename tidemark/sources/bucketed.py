"""Tables whose rows are replaced by key: buckets by a hash of the key, listed in manifests.

A write makes new files for the buckets it touches only and commits them by a manifest,
the next number, created where none is yet. So an upsert costs what its buckets hold, a
reader keeps the version it opened, and of two writers the second finds the number taken:
it goes on where the first changed other buckets, and else merges anew.

The root must be in a store whose create-if-absent is atomic, as HDFS or a local disk.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import create_absent, delete, list_objects, newest_version, read_text, stored

BUCKETS, ATTEMPTS, PAUSE = 64, 20, 0.2


class Conflict(Exception):
    """Another writer changed the same buckets each time."""


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    buckets: int
    schema: dict
    properties: dict = field(default_factory=dict)
    #: Bucket number, as a string, to its files below the root.
    files: dict = field(default_factory=dict)


class Table:
    """A bucketed table below `root`."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType, key: str = "id", buckets: int = BUCKETS, **properties) -> Table:
        """The table at `root`, made if there is none; one that is there must have the same properties."""
        table = cls(spark, root)
        while (found := table._newest())[0] is None:
            if not table._commit(Manifest(found[1], key, buckets, schema.jsonValue(), properties)):
                time.sleep(PAUSE)  # another writer makes it
        there = found[0]
        if there.properties != properties or there.key != key:
            raise ValueError(f"{root} has {there.properties} by {there.key}, not {properties} by {key}")
        return table

    def _newest(self) -> tuple[Manifest | None, int]:
        """(the newest manifest, the number that the next one takes)."""
        found = newest_version(self.spark, f"{self.root}/manifests")
        return Manifest(**found.body) if found.body else None, found.next

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest manifest, or a certain one; one that is still being written does not count."""
        if version is None:
            return self._newest()[0]
        text = read_text(self.spark, f"{self.root}/manifests/{version:012d}.json")
        try:
            return Manifest(**json.loads(text or ""))
        except ValueError:
            return None

    def _commit(self, made: Manifest) -> bool:
        """Whether the manifest's number was free."""
        return create_absent(self.spark, f"{self.root}/manifests/{made.version:012d}.json", json.dumps(made.__dict__))

    def _read(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        names = manifest.files if buckets is None else {str(b): manifest.files.get(str(b), []) for b in buckets}
        paths, schema = [f"{self.root}/{f}" for each in names.values() for f in each], StructType.fromJson(manifest.schema)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the newest version, or of an older one."""
        return self._read(self.manifest(version))

    def _bucket(self, manifest: Manifest) -> F.Column:
        return F.pmod(F.xxhash64(manifest.key), F.lit(manifest.buckets)).cast("int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among `keys`; only their buckets are read."""
        m = self.manifest()
        wanted = stored(keys.select(m.key).distinct(), "keys")
        return self._read(m, [r[0] for r in wanted.select(self._bucket(m)).distinct().collect()]).join(wanted, m.key, "left_semi")

    def upsert(self, rows: DataFrame, order: str | None = None) -> Manifest:
        """Put rows in, each instead of the one with its key; of several with one key the last by `order`, else any."""
        m = self.manifest()
        names = StructType.fromJson(m.schema).names
        one = F.max_by(F.struct(*names), order) if order else F.any_value(F.struct(*names))
        return self._replace(m, rows.groupBy(F.col(m.key).alias("_key")).agg(one.alias("r")).select("r.*"), True)

    def remove(self, keys: DataFrame) -> Manifest:
        """Take out the rows whose key is among `keys`."""
        m = self.manifest()
        return self._replace(m, keys.select(m.key).distinct(), False)

    def _replace(self, base: Manifest, rows: DataFrame, keep: bool) -> Manifest:
        given = stored(rows.withColumn("_bucket", self._bucket(base)), "upsert")
        touched = sorted(r[0] for r in given.select("_bucket").distinct().collect())  # at most the number of buckets
        if not touched:
            return base
        for _ in range(ATTEMPTS):
            old = self._read(base, touched).join(given.select(base.key), base.key, "left_anti").withColumn("_bucket", self._bucket(base))
            folder = f"data/{uuid.uuid4().hex}"
            new = old.unionByName(given) if keep else old
            new.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            files: dict[str, list[str]] = {str(b): [] for b in touched}
            for path in list_objects(self.spark, f"{self.root}/{folder}"):
                place = path[path.index(folder) :]
                files[place.split("_bucket=")[1].split("/")[0]].append(place)
            on, number = base, base.version + 1
            while True:
                made = replace(on, version=number, files={**on.files, **files})
                if self._commit(made):
                    return made
                last, (on, number) = on, self._newest()
                if on.version == last.version:
                    time.sleep(PAUSE)  # the writer that took the number has not ended, or is dead and will be passed over
                if any(on.files.get(b) != base.files.get(b) for b in files):
                    break  # the same buckets: what was merged is not the newest any more
            delete(self.spark, f"{self.root}/{folder}")
            base = on
        raise Conflict(self.root)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files that none of the newest `keep` versions has; the number of them."""
        newest = self.manifest().version
        used = {f for v in range(max(0, newest - keep + 1), newest + 1) if (m := self.manifest(v)) for each in m.files.values() for f in each}
        gone = [p for p in list_objects(self.spark, f"{self.root}/data") if p[p.rindex("/data/") + 1 :] not in used]
        for path in gone:
            delete(self.spark, path)
        return len(gone)
