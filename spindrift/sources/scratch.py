"""Scratch tables in the shared folder, groups of sorted streams, and memory given back."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (tests) one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    return _own_dirs[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by then
        pass


class Scratch:
    """Tables written to the shared folder and read again, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_remove, spark, self.path)

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        self._n += 1
        to = f"{self.path}/{self._n}"
        schema = df.schema
        df.write.mode("overwrite").options(**options).parquet(to)
        # shuffle files of what is now a table go when the driver's JVM finds them unused
        self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(schema).parquet(to)
        out._scratch = to
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        _remove(self.spark, df._scratch)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by long keys; only the open one is held."""
    held: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
        at = [0, *(np.flatnonzero((g[:, 1:] != g[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            key = tuple(g[:, a].tolist())
            if held and key != open_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            open_key = key
    if held:
        yield pa.Table.from_batches(held)


try:
    _libc = ctypes.CDLL(None)
    # glibc raises this threshold as large arrays come and go, after which their memory stays with the process
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
except (OSError, AttributeError):  # another C library
    _libc = None


def trim() -> None:
    """Gives memory that was freed back to the system: workers live on between stages, and an executor's limit counts what they keep."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
