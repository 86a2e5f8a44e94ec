"""A library of snapshots: every commit writes new Parquet tables and then, as the last step, a file that names them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from prismarium.schemas import DDL, VERSION, conform, schema


class Conflict(RuntimeError):
    """Someone else has changed a table since it was read; what was read is to be read again."""


@dataclass(frozen=True)
class Snapshot:
    """What a library held at one time."""

    library: Library
    number: int = 0
    paths: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """The rows with the current schema; tables of older snapshots get the columns they lack."""
        path = self.paths.get(name)
        if path is None:
            return self.library.spark.createDataFrame([], schema(name))
        return conform(self.library.spark.read.parquet(f"{self.library.folder}/{path}"), name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in DDL}


class Library:
    """Tables in ``folder``, on any file system that Spark reaches. A reader keeps the snapshot it opened; of two writers of one table the later gets a `Conflict`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Library:
        """Makes the folders that are missing."""
        library = Library(spark, folder)
        library._fs.mkdirs(library._path(f"{library.folder}/commits"))
        return library

    def snapshot(self) -> Snapshot:
        """The latest one whose file is whole."""
        at = self._path(f"{self.folder}/commits")
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []
        for name in reversed([n for n in names if n.endswith(".json")]):
            try:
                got = json.loads(self._text(f"{self.folder}/commits/{name}"))
            except ValueError:  # still being written
                continue
            return Snapshot(self, got["snapshot"], got["tables"])
        return Snapshot(self)

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def tables(self) -> dict[str, DataFrame]:
        return self.snapshot().tables()

    def commit(self, base: Snapshot | None = None, **tables: DataFrame) -> int:
        """Writes the given tables as a new snapshot; the others stay. Gives the snapshot's number.

        ``base`` is the snapshot that the tables were made from, by default the latest. Other tables may have changed since then, the
        given ones must not have.
        """
        base = base or self.snapshot()
        mine = {}
        for name, df in tables.items():
            mine[name] = f"{name}/{uuid.uuid4().hex}"
            conform(df, name).write.parquet(f"{self.folder}/{mine[name]}")
        while True:
            now = self.snapshot()
            changed = [name for name in mine if now.paths.get(name) != base.paths.get(name)]
            if changed:
                for path in mine.values():
                    self._fs.delete(self._path(f"{self.folder}/{path}"), True)
                raise Conflict(f"changed since snapshot {base.number}: {', '.join(changed)}")
            number = now.number + 1
            at = self._path(f"{self.folder}/commits/{number:010d}.json")
            try:
                out = self._fs.create(at, False)  # of two writers one fails here, and looks again
            except Exception:
                if self._fs.exists(at):
                    continue
                raise
            out.write(bytearray(json.dumps({"snapshot": number, "version": VERSION, "tables": now.paths | mine}).encode()))
            out.close()
            return number
