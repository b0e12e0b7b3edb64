"""Batches of a stream published once, whatever is replayed.

A micro-batch is written to a staging folder, renamed to its place (query, batch) and then noted in a commit
log. A batch that is noted is skipped when it comes again; one that failed before its note is published
anew in place of what it left. Readers see the noted batches only, so a table after a failure and a replay
equals one without.
"""

from __future__ import annotations

import math
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

FILE_BYTES = 128 << 20


class Published:
    """A table of published batches: ``path``/batches/<query>/<batch>, noted in ``path``/log/<query>/<batch>."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt

    def _file(self, *names: object) -> tuple[JavaObject, JavaObject]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, names)]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, *names: object) -> list[str]:
        fs, at = self._file(*names)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def committed(self, query: str, batch: int) -> bool:
        fs, at = self._file("log", query, batch)
        return fs.exists(at)

    def batches(self) -> list[tuple[str, int]]:
        return sorted((q, int(b)) for q in self._names("log") for b in self._names("log", q))

    def stage(self, df: DataFrame, file_bytes: int = FILE_BYTES, partitions: tuple[str, ...] = ()) -> str:
        """Write rows to a folder of their own; files much smaller than ``file_bytes`` are joined."""
        name = uuid.uuid4().hex
        self._write(df, f"{self.path}/staging/{name}", partitions)
        fs, at = self._file("staging", name)
        content = fs.getContentSummary(at)
        files = max(1, math.ceil(content.getLength() / file_bytes))
        if not partitions and content.getFileCount() > 2 * files + 1:  # the marker of success is a file too
            rows = self.spark.read.format(self.fmt).schema(df.schema).load(f"{self.path}/staging/{name}")
            joined = uuid.uuid4().hex
            self._write(rows.coalesce(files), f"{self.path}/staging/{joined}", partitions)
            fs.delete(at, True)
            name = joined
        return name

    def _write(self, df: DataFrame, folder: str, partitions: tuple[str, ...]) -> None:
        writer = df.write.format(self.fmt)
        (writer.partitionBy(*partitions) if partitions else writer).save(folder)

    def move(self, staged: str, query: str, batch: int) -> None:
        """Put a staged folder in the place of a batch that is not noted yet."""
        fs, source = self._file("staging", staged)
        _, target = self._file("batches", query, batch)
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot publish {target.toString()}")

    def note(self, query: str, batch: int) -> None:
        fs, at = self._file("log", query, batch)
        fs.create(at, True).close()

    def publish(self, df: DataFrame, query: str, batch: int, **kw) -> bool:
        """Publish a batch unless it has been; whether it was new."""
        if self.committed(query, batch):
            return False
        self.move(self.stage(df, **kw), query, batch)
        self.note(query, batch)
        return True

    def read(self, schema: str, batches: list[tuple[str, int]] | None = None) -> DataFrame:
        """All noted batches, or some of them."""
        found = self.batches() if batches is None else batches
        if not found:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/batches/{q}/{b}" for q, b in found]
        return self.spark.read.format(self.fmt).schema(schema).load(folders)

    def newest(self, query: str, before: int) -> tuple[str, int] | None:
        """The newest noted batch of a query before a batch."""
        found = [b for b in map(int, self._names("log", query)) if b < before]
        return (query, max(found)) if found else None

    def forget(self, query: str, before: int) -> None:
        """Remove older batches that nothing reads any more (their notes first)."""
        for batch in [b for b in map(int, self._names("log", query)) if b < before]:
            for place in ("log", "batches"):
                fs, at = self._file(place, query, batch)
                fs.delete(at, True)
