"""Checkpoints: versioned table folders with a manifest and digests, and roll-back of a failed step."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Checkpoints:
    """Named versions of a table under one folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def digest(self, name: str) -> DataFrame:
        """``path, sha256`` of the version's files; each file is hashed where it is read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{name}")
        return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), F.sha2("content", 256).alias("sha256"))

    def create(self, df: DataFrame, name: str) -> None:
        df.write.parquet(f"{self.folder}/{name}")
        self.digest(name).write.json(f"{self.folder}/{name}.manifest")

    def verify(self, name: str) -> bool:
        """Whether the files are those of the manifest."""
        wanted = self.spark.read.schema("path string, sha256 string").json(f"{self.folder}/{name}.manifest")
        found = self.digest(name)
        return wanted.exceptAll(found).isEmpty() and found.exceptAll(wanted).isEmpty()

    def restore(self, name: str) -> DataFrame:
        if not self.verify(name):
            raise ValueError(f"checkpoint {name} is damaged")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def names(self) -> list[str]:
        """Newest first, by name."""
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted((n for n in found if not n.endswith(".manifest")), reverse=True)

    def delete(self, name: str) -> None:
        for path in (f"{self.folder}/{name}", f"{self.folder}/{name}.manifest"):
            fs, p = self._fs(path)
            fs.delete(p, True)

    def keep_last(self, n: int) -> list[str]:
        gone = self.names()[n:]
        for name in gone:
            self.delete(name)
        return gone

    @contextlib.contextmanager
    def guarded(self, df: DataFrame, name: str) -> Iterator[None]:
        """A version of ``df`` that stays if the block fails and goes if it succeeds."""
        self.create(df, name)
        yield
        self.delete(name)
