"""What the operators share: the shared folder, materialised steps, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a table of measured size may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    (tests in local mode), a temporary folder that is set as the checkpoint folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or _own_dirs.get(sc.applicationId)
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tideline-shared-")
        sc.setCheckpointDir(where)
        atexit.register(_drop, where.removeprefix("file://"))
    return where.rstrip("/")


_own_dirs: dict[str, str] = {}


def _drop(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the driver removes it when it ends."""
    path = f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_hadoop, spark, path)
    return path


def _drop_hadoop(spark: SparkSession, path: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: its lineage ends there, every reader
    sees the same rows, and a lost executor costs no recomputation of what stands above."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and nothing will read again, before the driver ends."""
    for df in tables:
        _drop_hadoop(df.sparkSession, df._scratch)


#: Bytes of an Arrow batch between the JVM and a Python worker; both hold one, for each task at work.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Readies the session for Arrow functions: bounds the bytes of their batches, where that is still Spark's
    default, and sends this package to the executors, unless they find it by PYTHONPATH or their folder."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64MB") in ("64MB", "67108864b", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    known = [os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()] if p is not None]
    sc = spark.sparkContext
    if root in known or _shipped.get(sc.applicationId):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="tideline-ship-"), "tideline.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(Path(root, "tideline").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(at)
    _shipped[sc.applicationId] = True


_shipped: dict[str, bool] = {}


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Deals Arrow batches anew by bytes of the text column: each slice holds about most_bytes at
    most, or a single longer text."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(lengths(b.column(text)))
        at = 0
        while at < b.num_rows:
            past = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, past + most_bytes, "right")))
            yield b.slice(at, to - at)
            at = to


def release() -> None:
    """Gives what a Python worker has freed back to the system: Spark keeps the worker for other stages, whose
    memory would otherwise add up."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it frees as it likes


def lengths(a: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each text begins (one more offset than texts); null: empty."""
    import pyarrow.compute as pc

    a = pc.fill_null(a, "") if a.null_count else a
    a = a.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def task_id() -> int:
    from pyspark import TaskContext

    at = TaskContext.get()
    return at.partitionId() if at else 0
