"""Small files beside tables, in whatever file system Spark's path names."""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        """What stands in a folder, in order; hidden names and those being written are left out."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(path) if (n := s.getPath().getName())[0] not in "._")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def create(self, name: str, content: dict) -> bool:
        """Writes a file that doesn't exist yet; False if it does.  Of several writers one gets True."""
        try:
            out = self._fs.create(self._path(name), False)
        except Py4JJavaError as e:
            if "Exists" in e.java_exception.getClass().getName():
                return False
            raise
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> dict:
        """A file's content; one that its writer has just created is waited for."""
        for turn in range(50):
            stream = self._fs.open(self._path(name))
            try:
                raw = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            try:
                return json.loads(raw)
            except ValueError:
                if turn == 49:
                    raise
                time.sleep(0.05)
        raise AssertionError

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def rename(self, name: str, to: str) -> None:
        """One step for a whole folder."""
        self.make(to.rpartition("/")[0])
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{name} can't become {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
