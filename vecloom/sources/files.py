"""Small files through Hadoop's file systems: whatever Spark can reach, this can."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file in one step, unless there is one of that name; says whether it did."""
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(temporary), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(path):
            self.delete(temporary)
            return False
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri() if "://" in path else self._jvm.java.io.File("/").toURI(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(temporary), self._path(path), options)
        except Exception:
            self.delete(temporary)
            if self.exists(path):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
