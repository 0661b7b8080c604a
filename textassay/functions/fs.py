"""Small files in the shared store, through Hadoop's file systems.

Any path that Spark reads can be read and written. ``create`` relies on a rename that is
atomic and refuses an existing target, as HDFS and local file systems have it; on object
stores whose rename copies, two writers at one moment may both succeed, so a store there
needs a single writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, data: bytes) -> None:
        """Write a file, in place of one that stands there: written beside it and moved."""
        temp = self._path(f".{name.replace('/', '_')}-{uuid.uuid4().hex}")
        stream = self._fs.create(temp, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self._fs.delete(self._path(name), False)
        self._fs.rename(temp, self._path(name))

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does."""
        temp = f".{name.replace('/', '_')}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(temp), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(self._path(temp), self._path(name)):
            self._fs.delete(self._path(temp), False)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def delete_on_exit(self, name: str = "") -> None:
        """Delete when the application ends: what a lazy result is still read from."""
        self._fs.deleteOnExit(self._path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))
