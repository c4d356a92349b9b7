"""Small files that decide who comes first: numbered claims and versions in a folder that all writers share."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of small text files on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def names(self) -> list[str]:
        """Sorted; none where there is no folder."""
        path = self._path(self.root)
        return sorted(n for f in self._fs.listStatus(path) if not (n := f.getPath().getName()).startswith(".")) if self._fs.exists(path) else []

    def create(self, name: str, text: str = "") -> bool:
        """Whether this call made the file: of several writers one does. It appears whole, by a rename that never replaces."""
        aside, path = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            self._context.rename(aside, path, self._plain)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(aside, False)
            return False

    def read(self, name: str) -> str:
        path = self._path(f"{self.root}/{name}")
        size = self._fs.getFileStatus(path).getLen()
        stream = self._fs.open(path)
        try:
            return bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()


class Versions:
    """JSON states of something, the last of which holds. A state is put by whoever creates its number first."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def last(self) -> tuple[int, dict]:
        """Number and state; 0 and nothing at first."""
        done = self.folder.names()
        return (int(done[-1][1:]), json.loads(self.folder.read(done[-1]))) if done else (0, {})

    def put(self, number: int, state: dict) -> bool:
        """Whether it is this call's state that has the number."""
        return self.folder.create(f"v{number:08d}", json.dumps(state))
