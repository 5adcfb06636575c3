"""Small files in any file system that Spark reaches. A path without a scheme lies in Hadoop's default one."""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """A few calls of Hadoop's file systems; contents are small, they pass through the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.system: Any = self.place(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.place(path))

    def is_file(self, path: str) -> bool:
        return self.exists(path) and self.system.getFileStatus(self.place(path)).isFile()

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order; none if it is not there."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.place(path)))

    def write(self, path: str, content: bytes) -> None:
        """A new file that is there whole or not at all; the folder is made as needed."""
        half = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        out = self.system.create(self.place(half), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        if not self.system.rename(self.place(half), self.place(path)):
            self.delete(half)
            raise OSError(f"{half} cannot be renamed to {path}")

    def delete(self, path: str) -> None:
        self.system.delete(self.place(path), True)


def stamp() -> str:
    """A name for a new file; names sort by the time of their making."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
