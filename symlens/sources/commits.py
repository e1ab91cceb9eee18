"""A log of commits beside a folder's tables: each version of its state is one small file, put there whole in one step.

Tables are written first, under names that no version mentions yet, and become
part of the state by the commit that names them. A writer that read an older
version than the last is refused. File work goes through Hadoop, so any store
that Spark reads will do, as long as its rename doesn't overwrite.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class StaleVersion(RuntimeError):
    """Another writer has committed since the version that was read."""


class CommitLog:
    """Versions of a state, as JSON objects, under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self._hadoop.fs.Path(f"{self.path}/_log{'/' + name if name else ''}")

    @property
    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """All versions, oldest first."""
        fs = self._fs
        if not fs.exists(self._at()):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(self._at())]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{version:020}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The last version and its state; 0 and an empty state if there is none."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def commit(self, read: int, state: dict) -> int:
        """Make ``state`` the version after ``read``; :class:`StaleVersion` if there is such a version."""
        fs, aside = self._fs, self._at(f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self._conf).rename(fs.makeQualified(aside), fs.makeQualified(self._at(f"{read + 1:020}.json")), none)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e) or read + 1 in self.versions():
                raise StaleVersion(f"{self.path}: version {read} is not the last") from None
            raise
        return read + 1

    def drop_unnamed(self, named: set[str], of: str) -> list[str]:
        """Delete folders under ``path`` that begin with ``of`` and aren't in ``named``; returns their names."""
        fs = self._fs
        root = self._hadoop.fs.Path(self.path)
        gone = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(of) and f.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]
