"""Small metadata files on whatever file system Spark reads, through Hadoop's client."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> Any:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, path: str, value: Any) -> bool:
        """Writes a new file; False if another writer made it first."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        return True

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
