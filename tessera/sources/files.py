"""Binary vector files as Spark data sources, and their writers.

Formats: ``rawfloats`` (headerless float32, row-major; option ``dim``), ``fvecs`` and ``ivecs`` (each record an int32
length, then float32 or int32 values; option ``dim``). Files are cut into byte ranges of whole records, one task each,
and read through Hadoop's file system API in the JVM (``binaryFile``) only where the driver can't see the path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20


class ByteRange(InputPartition):
    def __init__(self, path: str, first: int, rows: int, base: int):
        self.path, self.first, self.rows, self.base = path, first, rows, base


class _Reader(DataSourceReader):
    def __init__(self, options: dict, header: bool, integers: bool):
        self.paths = [p for p in options["path"].split(",") if p]
        self.header, self.integers = header, integers
        self.dim = int(options["dim"])
        self.limit = int(options.get("limit", 0))
        if self.dim < 1:
            raise ValueError("dim must be at least 1")

    def record(self) -> int:
        return 4 * (self.dim + self.header)

    def partitions(self) -> list[ByteRange]:
        out, base, size = [], 0, self.record()
        step = max(1, RANGE_BYTES // size)
        for path in self.paths:
            n = os.path.getsize(path)
            if self.header and n % size:
                raise ValueError(f"{path}: {n} bytes is no whole number of records of {size}")
            rows = n // size if not self.limit else min(n // size, self.limit - base)
            out += [ByteRange(path, a, min(step, rows - a), base + a) for a in range(0, rows, step)]
            base += rows
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            f.seek(partition.first * self.record())
            left, at = partition.rows, partition.base
            while left:
                n = min(left, 8192)
                block = np.frombuffer(f.read(n * self.record()), "<i4").reshape(n, -1)
                if self.header and (block[:, 0] != self.dim).any():
                    raise ValueError(f"{partition.path}: a record isn't of length {self.dim}")
                values = np.ascontiguousarray(block[:, self.header :])
                flat = pa.array(values.ravel()) if self.integers else pa.array(values.view("<f4").ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.dim, pa.int32()), flat)], ["id", "series"])
                at, left = at + n, left - n


class RawFloats(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawfloats"

    def schema(self) -> str:
        return "id bigint, series array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, header=False, integers=False)


class Fvecs(RawFloats):
    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, header=True, integers=False)


class Ivecs(RawFloats):
    @classmethod
    def name(cls) -> str:
        return "ivecs"

    def schema(self) -> str:
        return "id bigint, series array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, header=True, integers=True)


def register(spark: SparkSession) -> None:
    for source in (RawFloats, Fvecs, Ivecs):
        spark.dataSource.register(source)


def read_raw(spark: SparkSession, path: str, dim: int, n: int = 0) -> DataFrame:
    """Headerless float32 rows. With n, exactly that many must be there; without, a partial last record is dropped."""
    register(spark)
    df = spark.read.format("rawfloats").option("dim", dim).option("limit", n).load(path)
    if n and os.path.getsize(path) < 4 * dim * n:
        raise ValueError(f"{path} has fewer than {n} rows of {dim}")
    return df


def vecs_dim(path: str) -> int:
    with open(path, "rb") as f:
        head = f.read(4)
    if len(head) < 4:
        raise ValueError(f"{path} is empty")
    return int(np.frombuffer(head, "<i4")[0])


def read_fvecs(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    register(spark)
    return spark.read.format("fvecs").option("dim", vecs_dim(path)).option("limit", limit).load(path)


def read_ivecs(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    register(spark)
    return spark.read.format("ivecs").option("dim", vecs_dim(path)).option("limit", limit).load(path)


def read_binary(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Headerless float32 files by any path that Spark reads; one task a file, ids from the file order and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(content, "<f4", count=len(content) // (4 * dim) * dim).reshape(-1, dim)
                for a in range(0, len(x), 8192):
                    part = x[a : a + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dim, pa.int32()), pa.array(part.ravel()))], ["path", "place", "series"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, place bigint, series array<float>")


def file_metadata(path):
    """From a file name column: series length (``len256``), rows (``size50K`` or ``size2M``), and whether control or query."""
    number = F.regexp_extract(path, r"size(\d+)[MK]?", 1)
    unit = F.regexp_extract(path, r"size\d+([MK])?", 1)
    rows = number.try_cast("bigint") * F.when(unit == "M", 1_000_000).when(unit == "K", 1000).otherwise(1)
    return F.struct(
        F.regexp_extract(path, r"len(\d+)", 1).try_cast("int").alias("dim"), rows.alias("n"), path.contains("ctrl").alias("is_control"),
        F.regexp_extract(path, r"_q(\d+)", 1).try_cast("int").alias("n_query"), F.regexp_extract(path, r"_k(\d+)", 1).try_cast("int").alias("k"),
    )


# sinks


def write_series(df: DataFrame, path: str) -> None:
    df.select("id", "series").write.parquet(path)


def write_top_k_text(result: DataFrame, path: str) -> None:
    """Two folders of text files, ``indices`` and ``distances``: one line a query in qid order, nearest first."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "id", "dist")))
    lines = result.groupBy("qid").agg(pairs.alias("p"))
    lines = lines.repartitionByRange("qid").sortWithinPartitions("qid")
    lines.select(F.array_join(F.transform("p", lambda x: x["id"].cast("string")), " ").alias("value")).write.text(f"{path}/indices")
    lines.select(F.array_join(F.transform("p", lambda x: F.format_string("%.15f", x["dist"])), " ").alias("value")).write.text(f"{path}/distances")


def write_range(result: DataFrame, path: str) -> None:
    """Long form, sorted by (qid, dist, id) inside range partitions."""
    result.repartitionByRange("qid").sortWithinPartitions("qid", "dist", "id").write.parquet(path)
