"""Small files and folders on whatever file system a warehouse lives on, through Hadoop's client."""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str, older_s: float = -math.inf) -> list[str]:
        """What stands in a folder; only what was last changed more than older_s seconds ago."""
        if not self.exists(path):
            return []
        latest = 1000 * (time.time() - older_s)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.getModificationTime() < latest)

    def read(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, data: str | bytes) -> None:
        """Writes a new file: it is there as a whole or not at all. A file of that name must not exist."""
        new = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(new), True)
        try:
            stream.write(bytearray(data.encode() if isinstance(data, str) else data))
        finally:
            stream.close()
        self.rename(new, path)

    def put(self, path: str, data: bytes) -> None:
        """Writes a file in a place where nobody looks yet."""
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def move(self, old: str, new: str) -> None:
        """Like rename(), into a folder that may be missing."""
        self.make(new.rsplit("/", 1)[0])
        self.rename(old, new)

    def sizes(self, path: str) -> list[int]:
        """Bytes of the folder's Parquet files."""
        return [s.getLen() for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().endswith(".parquet")]

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
