"""Small stored state of a catalog: definitions, bindings, accounting. One JSON document a folder, in numbered versions on the shared file system."""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .definition import Invalid


class Document:
    """A write names the version that it was derived from and creates the file of the next; where that is there already, another writer was first and
    nothing changes. On an object store this needs a create that refuses what is there."""

    KEEP = 3

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark.sparkContext._jvm
        self.root, self.path = root.rstrip("/"), jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _file(self, number: int):
        return self.path(f"{self.root}/{number:012d}.json")

    def read(self) -> tuple[int, Any]:
        """The newest version and its value; (0, None) where there is none."""
        found = self._versions()
        if not found:
            return 0, None
        stream = self.fs.open(self._file(found[-1]))
        try:
            return found[-1], json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write(self, value: Any, after: int) -> int:
        try:
            out = self.fs.create(self._file(after + 1), False)
        except Py4JJavaError as e:
            raise Invalid(f"version {after + 1} was written by another") from e
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        for old in self._versions()[: -self.KEEP]:
            self.fs.delete(self._file(old), False)
        return after + 1
