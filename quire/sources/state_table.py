"""Versioned tables of states: rows are appended, versions are committed by a pointer file.

A writer puts its rows into a folder of their own and then tries to create the pointer of the
next version, which lists the folders that make it up. Creating a pointer that is there already
fails, so of two writers from the same version one wins and the other gets a Conflict and leaves
the table as it was. A writer that is lost before that leaves rows that no version names. Readers
see one version, whatever is written meanwhile. Compaction is a version like any other.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has committed a version since the one that this writer started from."""


class StateTable:
    """States in a folder that all executors see; keys name what a state is of, order tells the latest."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], order: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T.StructType.fromDDL(schema)
        self.keys, self.order = list(keys), order
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The latest version; 0 before the first."""
        found = self._fs.globStatus(self._path("_versions/*.json"))
        return max((int(s.getPath().getName().split(".")[0]) for s in found or []), default=0)

    def _folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        stream = self._fs.open(self._path(f"_versions/{version:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)["folders"]

    def _commit(self, version: int, folders: list[str]) -> None:
        """Create the pointer of a version, whole, and only if it isn't there."""
        self._fs.mkdirs(self._path("_versions"))
        part, target = self._path(f"_versions/{uuid.uuid4().hex}.part"), self._path(f"_versions/{version:012d}.json")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":  # a local rename would replace; a link doesn't
            try:
                os.link(part.toUri().getPath(), target.toUri().getPath())
                won = True
            except FileExistsError:
                won = False
        else:
            won = not self._fs.exists(target) and self._fs.rename(part, target)
        if self._fs.exists(part):
            self._fs.delete(part, False)
        if not won:
            raise Conflict(f"version {version} of {self.folder} is there already")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the latest)."""
        folders = self._folders(self.version() if version is None else version)
        rows = self.spark.read.schema(self.schema)
        return rows.parquet(*(f"{self.folder}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def save(self, rows: DataFrame, expected: int | None = None) -> int:
        """Append rows and commit them as the version after expected (the latest); the new version's number, or a Conflict."""
        before = self.version() if expected is None else expected
        folder = f"rows-{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).write.parquet(f"{self.folder}/{folder}")
        self._commit(before + 1, [*self._folders(before), folder])
        return before + 1

    def latest(self, version: int | None = None) -> DataFrame:
        """The latest row of each key; of equals in order any one."""
        others = F.struct(*(f.name for f in self.schema if f.name not in self.keys))
        return self.read(version).groupBy(*self.keys).agg(F.max_by(others, self.order).alias("_s")).select(*self.keys, "_s.*").select(*self.schema.names)

    def compact(self) -> int:
        """A version of the latest rows only, in one folder; earlier versions can still be read."""
        before = self.version()
        folder = f"rows-{uuid.uuid4().hex}"
        self.latest(before).write.parquet(f"{self.folder}/{folder}")
        self._commit(before + 1, [folder])
        return before + 1
