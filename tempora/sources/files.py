"""Small files beside the data, through Spark's own file systems, so that any store it reads works."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._root = self._path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self, below: str = "") -> list[str]:
        p = self._at(below) if below else self._root
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def ages(self, below: str) -> dict[str, float]:
        """Names below a folder with the seconds since each was changed."""
        p = self._at(below)
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in self._fs.listStatus(p)} if self._fs.exists(p) else {}

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> dict:
        s = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(s.readAllBytes()).decode())
        finally:
            s.close()

    def _take(self, draft, name: str) -> bool:
        """Give a draft its name unless that is taken. A rename fails then, but not on a local disk, where a hard link does."""
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(draft, self._at(name))
        local = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self.spark._jvm.java.nio.file.Files.createLink(local(self._at(name)), local(draft))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        self._fs.delete(draft, False)
        return True

    def publish(self, name: str, value: dict) -> bool:
        """Write a new JSON file as a whole; False if it is there already. Of several writers of a name one wins."""
        if self.exists(name):
            return False
        draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        s = self._fs.create(draft, True)
        try:
            s.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            s.close()
        if not self.exists(name) and self._take(draft, name):
            return True
        self._fs.delete(draft, False)
        return False

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, name: str, to: str) -> bool:
        return self._fs.rename(self._at(name), self._path(to))
