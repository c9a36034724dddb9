"""Intermediate tables in the cluster's shared folder, and other things all operators need."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
    return "file://" + _OWN["root"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that one run of an operator writes and reads back.

    Writing cuts the lineage: an executor that is lost later costs a reread, not the stages before. ``drop`` frees a
    table as soon as nothing reads it any more; what the returned DataFrame still reads stays until the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        _TO_CLEAN.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        conf = self.spark.conf
        before = conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")  # the shuffles of this write go as soon as it has ended
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _delete(self.spark, frame._scratch_path)


_TO_CLEAN: list[Scratch] = []


def _clean() -> None:
    for s in _TO_CLEAN:
        try:
            if s.spark.sparkContext._jsc is not None:
                _delete(s.spark, s.root)
        except Exception:  # the JVM may be gone at exit; the folder is the cluster's to clear then
            return


atexit.register(_clean)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Returns what this process has freed to the system. A Python worker lives on when its task has ended, and others
    start beside it; what it holds without use counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
