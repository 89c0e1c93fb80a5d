"""Tables that are written atomically and once: versions, a pointer for each, and a log of batches.

A table is a folder: ``data/<random>`` holds Parquet files that never change, ``versions/<n>`` is a small text that names
the folders of version n and the last batch of each stream that it holds. A commit writes its data first, then its version
by one rename that fails where that version exists already. So

- a reader sees the version before or the version after, whole, whatever happens in between;
- of two writers at once one takes the number; the other looks again and commits behind it, or is told (``Conflict``) if it
  had named the version that it expected;
- a batch of a stream that is run again (its output lost, or written but not acknowledged) is found in the log and
  changes nothing.

Data folders that no version names, left by writers that died, are removed by ``vacuum``, as are old versions. The rename
must be exclusive, as in HDFS and local file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from idloom.operators import sweeps

#: Digits of a version's name, so that names sort as numbers.
_DIGITS = 12
#: Times that a commit looks again after losing its number to another writer.
TRIES = 50


class Conflict(Exception):
    """The table has another version than the writer expected."""


class Files:
    """The few calls of the session's file system that this needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = lambda p: self.jvm.org.apache.hadoop.fs.Path(p)
        self.files = self.path(root).getFileSystem(self.conf)
        self.root = self.files.makeQualified(self.path(root))
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []

    def write(self, path: str, text: str) -> None:
        out = self.files.create(self.path(path), True)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def read(self, path: str) -> str:
        stream = self.files.open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def move(self, source: str, target: str, replace: bool = False) -> bool:
        """One atomic rename; False if the target exists and isn't to be replaced."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getDeclaringClass(), 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            self.context.rename(self.path(source), self.path(target), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self.files.delete(self.path(path), True)


class VersionedTable:
    """A table at ``path`` with the columns of ``schema`` (where it is None: those of its first commit)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str | None = None):
        self.spark, self.files = spark, Files(spark, path)
        self.path = self.files.root.toString()
        self.schema = schema

    # ------------------------------------------------------------ reading

    def version(self) -> int:
        """The number of the current version; 0 before the first."""
        return max((int(n) for n in self.files.names(f"{self.path}/versions") if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/versions/{version:0{_DIGITS}}")) if version else {"folders": [], "batches": {}, "schema": None}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the current one where none is given)."""
        manifest = self._manifest(self.version() if version is None else version)
        known = manifest["schema"] and StructType.fromJson(manifest["schema"])
        schema = known or self.schema
        if schema is None:
            raise ValueError(f"{self.path} has no version and no schema yet")
        folders = [f"{self.path}/data/{f}" for f in manifest["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ writing

    def _written(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _publish(self, version: int, manifest: dict) -> bool:
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self.files.write(draft, json.dumps(manifest))
        self.files.files.mkdirs(self.files.path(f"{self.path}/versions"))
        done = self.files.move(draft, f"{self.path}/versions/{version:0{_DIGITS}}")
        if not done:
            self.files.remove(draft)
        return done

    def commit(self, change: Callable[[DataFrame | None], DataFrame], append: bool = False, expected: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Publish the next version and return its number: ``change`` makes its rows from those of the current version
        (None before the first), or with ``append`` the rows that it adds to them. With ``expected``, only if that is the
        current version. With ``batch`` (a stream's name and a batch's number), only if the table doesn't hold it yet."""
        added = None
        for _ in range(TRIES):
            now = self.version()
            if expected is not None and now != expected:
                raise Conflict(f"version {now} instead of {expected}")
            manifest = self._manifest(now)
            if batch and batch[1] <= manifest["batches"].get(batch[0], -1):
                return now
            if not append or added is None:
                rows = change(None if append or not now else self.read(now))
                added, schema = self._written(rows), json.loads(rows.schema.json())
            batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
            if self._publish(now + 1, {"folders": (manifest["folders"] if append else []) + [added], "batches": batches, "schema": manifest["schema"] if append and manifest["schema"] else schema}):
                return now + 1
            if not append:
                self.files.remove(f"{self.path}/data/{added}")
        raise Conflict(f"{self.path}: no free version in {TRIES} tries")

    def replace(self, rows: DataFrame, **options: Any) -> int:
        return self.commit(lambda _: rows, **options)

    def append(self, rows: DataFrame, **options: Any) -> int:
        return self.commit(lambda _: rows, append=True, **options)

    def keep_latest(self, rows: DataFrame, key: list[str], version: str, arrival: str, **options: Any) -> int:
        """The latest row of each key among the table's and ``rows``."""
        return self.commit(lambda old: sweeps.latest(rows if old is None else old.unionByName(rows), key, version, arrival), **options)

    def insert_once(self, rows: DataFrame, key: list[str], order: list[str], **options: Any) -> int:
        """The table and the first of ``rows`` for each key that it lacks."""
        return self.commit(lambda old: sweeps.insert_once(old, rows, key, order), **options)

    def compact(self) -> int:
        """The same rows in one folder, as many small appends leave many."""
        return self.commit(lambda old: old)

    def vacuum(self, keep_versions: int = 2) -> None:
        """Remove all versions but the last few, and data that no kept version names. Not while others write or read
        older versions."""
        versions = sorted(int(n) for n in self.files.names(f"{self.path}/versions") if n.isdigit())
        kept = versions[-keep_versions:]
        named = {f for v in kept for f in self._manifest(v)["folders"]}
        for v in versions[: len(versions) - len(kept)]:
            self.files.remove(f"{self.path}/versions/{v:0{_DIGITS}}")
        for f in self.files.names(f"{self.path}/data"):
            if f not in named:
                self.files.remove(f"{self.path}/data/{f}")
        self.files.remove(f"{self.path}/drafts")

    # ------------------------------------------------------------ streams

    def writer(self, stream: str, how: str = "append", **keys: Any) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: every batch of ``stream`` once, by ``append``, ``replace``, ``keep_latest`` or
        ``insert_once`` (with their keys). ``stream`` must name one query and its checkpoint."""
        act = getattr(self, how)

        def write(rows: DataFrame, number: int) -> None:
            act(rows, **keys, batch=(stream, number))

        return write


def save_file(rows: DataFrame, path: str) -> None:
    """A few rows as one Parquet file, put in the place of the old one by a single rename: a reader finds one or the other."""
    files, beside = Files(rows.sparkSession, path), f"{path}.{uuid.uuid4().hex}.tmp"
    rows.coalesce(1).write.parquet(beside)
    try:
        part = next(n for n in files.names(beside) if n.startswith("part-"))
        if files.files.exists(files.root) and files.files.getFileStatus(files.root).isDirectory():
            files.remove(path)  # a folder of rows, as they were saved before
        files.move(f"{beside}/{part}", path, replace=True)
    finally:
        files.remove(beside)
