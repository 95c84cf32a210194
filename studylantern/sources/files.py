"""The few file operations that table commits need, on any store that Spark reads."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed this version meanwhile."""


class Folder:
    """A folder of a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder below; none where it does not exist."""
        if not self._fs.exists(self._at(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def age_seconds(self, name: str) -> float:
        """Since the last change, by this machine's clock."""
        now = self._jvm.java.lang.System.currentTimeMillis()
        return (now - self._fs.getFileStatus(self._at(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file whole or not at all; refused where the name is taken."""
        draft = f".{uuid.uuid4().hex}.draft"
        stream = self._fs.create(self._at(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self._conf)
        none = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        parent = name.rpartition("/")[0]
        self._fs.mkdirs(self._at(parent))
        try:
            context.rename(self._at(draft), self._at(name), none)
        except Py4JJavaError as error:
            self.remove(draft)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise CommitConflict(f"{self.path}/{name} was committed by another writer") from None
            raise

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
