"""Tables in versions: read, join, write to a new folder, then swap the pointer.

Nothing that may be being read is ever written over. A commit writes its tables to a
folder of its own and then claims the next version number by renaming a small file to
it, which fails if the number is taken; until that moment nobody sees the folder, and
from then on everybody sees all of it. Readers take the greatest number. Paths may lie
in any store that Hadoop's file contexts reach with a rename that does not replace.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from . import tables

#: Digits of a version number in a file name, so that names sort as numbers do.
DIGITS = 12


class Conflict(RuntimeError):
    """Another writer took the version that a commit was to make."""


class Store:
    """Versions of a set of named tables below ``path``: ``versions/<number>`` holds the
    name of the folder below ``data`` with one Parquet folder per table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        self.fs.mkdirs(self._path(f"{self.path}/versions"))

    def version(self) -> int:
        """The latest version, 0 before the first commit."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def folder(self, version: int) -> str:
        stream = self.fs.open(self._path(f"{self.path}/versions/{version:0{DIGITS}d}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of one version, the latest unless named; later commits don't change it."""
        return self.spark.read.parquet(f"{self.path}/data/{self.folder(self.version() if version is None else version)}/{name}")

    def write(self, frames: Mapping[str, DataFrame]) -> str:
        """Tables in a new folder that no version names yet."""
        folder = uuid.uuid4().hex
        for name, df in frames.items():
            df.write.parquet(f"{self.path}/data/{folder}/{name}")
        return folder

    def publish(self, folder: str, after: int) -> int:
        """Make ``folder`` the version that follows ``after``, or raise ``Conflict``."""
        claim = self._path(f"{self.path}/versions/_claim-{folder}")
        out = self.fs.create(claim, False)
        out.writeUTF(folder)
        out.close()
        try:
            self._files.rename(claim, self._path(f"{self.path}/versions/{after + 1:0{DIGITS}d}"), self._plain)
        except Py4JJavaError as error:
            self.fs.delete(claim, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {after + 1} of {self.path} is taken") from error
            raise
        return after + 1

    def update(self, change: Callable[[int], Mapping[str, DataFrame]], attempts: int = 5) -> int:
        """Commit what ``change`` makes of the latest version, whose number it gets. If
        another writer was first, it is made again of that writer's version."""
        for _ in range(attempts):
            base = self.version()
            try:
                return self.publish(self.write(change(base)), base)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {attempts} attempts, each overtaken")


def merge_into(store: Store, updates: DataFrame) -> int:
    """``merge_graph`` into a store that holds concepts, decisions, edges and conflicts.
    Conflicts of earlier merges stay; a version without the tables starts empty."""
    spark = store.spark
    empty = {
        "concepts": "id string, name string, domain string, aliases array<string>",
        "decisions": "id string, concept_id string, rule string, source string, rationale string, effective_date string",
        "edges": "src string, pred string, dst string",
        "conflicts": None,
    }

    def change(version: int) -> dict[str, DataFrame]:
        held = {n: store.read(n, version) if version else spark.createDataFrame([], s) for n, s in empty.items() if version or s}
        concepts, decisions, edges, conflicts = tables.merge_graph(held["concepts"], held["decisions"], held["edges"], updates)
        if version:
            conflicts = held["conflicts"].unionByName(conflicts).distinct()
        return {"concepts": concepts, "decisions": decisions, "edges": edges, "conflicts": conflicts}

    return store.update(change)
