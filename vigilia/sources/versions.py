"""Tables whose states are published whole: every write goes to a folder of its own, and a small commit file names the current one.

A reader takes the newest commit and reads the folder it names, so it sees the old state or the new one, never a part of either, and a
DataFrame it has at hand keeps reading the state it began with. A writer that dies leaves a folder that no commit names. Of two writers
at once both commits stand, the later number being current. A table may be read and published in one job, without a way over a copy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """The table below ``root``: version folders, and commits named by their number."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def commits(self) -> list[tuple[int, str]]:
        """Number and version of each complete commit, the newest first; one without its closing line feed was never finished."""
        found = []
        for number in sorted((int(n) for n in self._names(f"{self.root}/_commits") if n.isdigit()), reverse=True):
            stream = self._fs.open(self._place(f"{self.root}/_commits/{number:010d}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                found.append((number, text.strip()))
        return found

    def exists(self) -> bool:
        return bool(self.commits())

    def read(self) -> DataFrame:
        commits = self.commits()
        if not commits:
            raise FileNotFoundError(f"{self.root} has no published state")
        return self.spark.read.parquet(f"{self.root}/{commits[0][1]}")

    def prepare(self, df: DataFrame) -> str:
        """Writes a state that no reader sees yet; returns its version."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{version}")
        return version

    def commit(self, version: str) -> int:
        """Makes a prepared state the current one. The number is taken by creating the file, which only one writer can."""
        number = max((n for n in map(int, filter(str.isdigit, self._names(f"{self.root}/_commits")))), default=0) + 1
        while True:
            place = self._place(f"{self.root}/_commits/{number:010d}")
            try:
                out = self._fs.create(place, False)
                break
            except Exception:
                if not self._fs.exists(place):
                    raise
                number += 1
        out.write(bytearray(f"{version}\n".encode()))
        out.close()
        return number

    def publish(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as the new current state and reads it back."""
        self.commit(self.prepare(df))
        return self.read()

    def release(self, keep: int = 1) -> list[str]:
        """Deletes the states older than the newest ``keep``, and those that a dead writer left; call it when no writer is at work."""
        commits = self.commits()
        live = {version for _, version in commits[:keep]}
        gone = [n for n in self._names(self.root) if n.startswith("v-") and n not in live]
        for number, version in commits[keep:]:
            self._fs.delete(self._place(f"{self.root}/_commits/{number:010d}"), False)
        for name in gone:
            self._fs.delete(self._place(f"{self.root}/{name}"), True)
        return gone
