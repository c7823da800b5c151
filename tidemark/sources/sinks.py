"""A sink of JSON Lines files that a run has as a whole or not at all.

Tasks write files of a certain number of rows into a folder of their own; only the
driver's commit, once every task has ended, moves them into the run. A task that fails,
or runs twice, leaves nothing there, and an abort removes what was written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a file, and the rest below which it goes into the file before (fixed values).
FILE_ROWS, LEAST_REST = 500, 100


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class LinesWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.rows = options["path"].rstrip("/"), int(options.get("rows", FILE_ROWS))
        self.overwrite, self.staging, self.names = overwrite, f"_staging-{uuid.uuid4().hex}", schema.names

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path.replace("s3a://", "s3://", 1))

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, at = self._store()
        fs.create_dir(f"{at}/{self.staging}", recursive=True)
        own, files, held = uuid.uuid4().hex, [], []

        def flush(rows: list[str]) -> None:
            name = f"part-{own}-{len(files):06d}.jsonl"
            with fs.open_output_stream(f"{at}/{self.staging}/{name}") as out:
                out.write("".join(rows).encode())
            files.append(name)

        for row in iterator:
            held.append(json.dumps(dict(zip(self.names, row, strict=True)), ensure_ascii=False, default=str) + "\n")
            if len(held) >= self.rows + LEAST_REST:
                flush(held[: self.rows])
                held = held[self.rows :]
        if len(held) > self.rows and len(held) - self.rows >= LEAST_REST:
            flush(held[: self.rows])
            held = held[self.rows :]
        if held:
            flush(held)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = self._store()
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.is_file] if self.overwrite else []
        for m in messages:
            for name in m.files if m else ():
                fs.move(f"{at}/{self.staging}/{name}", f"{at}/{name}")
        for path in old:
            fs.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = self._store()
        if fs.get_file_info(f"{at}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.staging}")


class LinesSink(DataSource):
    """df.write.format("lines").option("path", a URI).mode("append" or "overwrite").save(); `rows` sets the rows of a file."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        raise NotImplementedError("read it as JSON")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LinesWriter(self.options, schema, overwrite)
