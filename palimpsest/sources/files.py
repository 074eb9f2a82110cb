"""Files by way of Hadoop's file systems, so that a store can lie anywhere Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.commons.io.IOUtils
        self._charset = jvm.java.nio.charset.StandardCharsets.UTF_8

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        """What lies in a folder, sorted; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._utils.toString(stream, self._charset)
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a whole file at once, under its name only when it's complete. False: the name is taken."""
        part = f"{name}.part"
        stream = self._fs.create(self._at(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name):
            self._fs.delete(self._at(part), False)
            return False
        return bool(self._fs.rename(self._at(part), self._at(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
