"""The few file operations that commits need, on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.root = self._path(root)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str, prefix: str = "") -> list[str]:
        p = self._path(path)
        return sorted(n for s in self.fs.listStatus(p) if (n := s.getPath().getName()).startswith(prefix)) if self.fs.exists(p) else []

    def bytes(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str = "") -> bool:
        """A new whole file, or False where there is one of that name."""
        own = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(own, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._path(path)
        if not self.fs.exists(target) and self.fs.rename(own, target):
            return True
        self.fs.delete(own, False)
        return False

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
