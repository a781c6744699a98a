"""Targets as versioned Parquet folders: a version is written aside and published by one pointer file.

    <root>/v-<name>/...      versions, each a complete table
    <root>/_CURRENT-<n>      pointer files that hold a version's name; the highest number counts
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Scratch folders have names that begin so; nothing else is dropped as scratch.
SCRATCH_PREFIX = "tideline_scratch_"


def scratch_path(root: str) -> str:
    return f"{root.rstrip('/')}/{SCRATCH_PREFIX}{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder; refuses any other path."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not name.startswith(SCRATCH_PREFIX) or name == SCRATCH_PREFIX or ".." in path:
        raise ValueError(f"{path!r} is not a scratch folder")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV: every value quoted, quotes doubled, a header in each file. NULL is an empty field, as empty text is, which the
    target holds as NULL."""
    df.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


class TargetStore:
    """One target. Paths are any that Hadoop's file systems know; only they are used."""

    PREFIX = "v-"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        at = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().startswith(prefix)) if self._fs.exists(at) else []

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, version); a pointer whose writer has not finished is not there yet."""
        out = []
        for name in self._names("_CURRENT-"):
            at = self._path(f"{self.root}/{name}")
            if self._fs.getFileStatus(at).getLen():
                stream = self._fs.open(at)
                out.append((int(name.removeprefix("_CURRENT-")), stream.readUTF()))
                stream.close()
        return sorted(out)

    def current(self) -> str | None:
        """The published version's path."""
        found = self._pointers()
        return f"{self.root}/{self.PREFIX}{found[-1][1]}" if found else None

    def read(self) -> DataFrame | None:
        at = self.current()
        return self.spark.read.parquet(at) if at else None

    def stage(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Writes a version without publishing it; a failure leaves the target as it was."""
        name = uuid.uuid4().hex
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{self.PREFIX}{name}")
        return name

    def read_version(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.PREFIX}{name}")

    def publish(self, name: str) -> None:
        """Makes a staged version the current one. The pointer's number is taken by an exclusive create, so
        of two publishers one fails."""
        taken = [int(n.removeprefix("_CURRENT-")) for n in self._names("_CURRENT-")]
        out = self._fs.create(self._path(f"{self.root}/_CURRENT-{max(taken, default=0) + 1:012d}"), False)
        out.writeUTF(name)
        out.close()

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        self.publish(self.stage(df, partition_by))

    def stale(self) -> list[str]:
        """Versions that are not current: leftovers of failed runs and older states. Only listed."""
        now = self.current()
        return [v for v in self._names(self.PREFIX) if f"{self.root}/{v}" != now]

    def drop(self, version: str) -> None:
        """Deletes a version that is not current; refuses any other name."""
        if not version.startswith(self.PREFIX) or "/" in version or f"{self.root}/{version}" == self.current():
            raise ValueError(f"{version!r} is not a stale version")
        self._fs.delete(self._path(f"{self.root}/{version}"), True)
