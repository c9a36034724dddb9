"""Series from memory, generators, samples and a registry of data sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns


def from_numpy(spark: SparkSession, x: np.ndarray, first_id: int = 0) -> DataFrame:
    """A 2-D array of any layout as (id, series); values become float32 and are copied."""
    x = np.ascontiguousarray(np.asarray(x, dtype=np.float32)) if np.ndim(x) == 2 else None
    if x is None:
        raise ValueError("series must be a two-dimensional array")
    n, dim = x.shape
    table = pa.table({"id": pa.array(np.arange(first_id, first_id + n)), "series": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.ravel()))})
    return spark.createDataFrame(table)


def queries_from_numpy(spark: SparkSession, q: np.ndarray) -> DataFrame:
    return from_numpy(spark, q).toDF("qid", "q")


def random_series(spark: SparkSession, n: int, dim: int, seed: int, normalize: bool = True) -> DataFrame:
    """Uniform values that depend on (seed, id, place) only, z-normalized unless told otherwise."""
    value = lambda i: (F.xxhash64(F.lit(seed), F.col("id"), i).bitwiseAND(2**53 - 1) / float(2**53)).cast("double")
    s = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)
    return spark.range(n).select("id", (columns.z_normalize(s) if normalize else s).cast("array<float>").alias("series"))


def sinusoids(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """sin(0.07 j + p) + 0.5 cos(0.19 j - p) with phase p = 0.013 id."""
    p = F.col("id") * 0.013
    s = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.sin(j * 0.07 + p) + F.cos(j * 0.19 - p) * 0.5)
    return spark.range(n).select("id", s.cast("array<float>").alias("series"))


def sample(series: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer) without replacement; the same ones for the same seed."""
    return series.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


@dataclass(frozen=True)
class Dataset:
    """Where the parts of a benchmark data set lie."""

    base: str
    queries: dict[str, str]
    truth: str | None = None
    format: str = "fvecs"


class Registry:
    """Data sets by name; paths are the caller's."""

    def __init__(self) -> None:
        self.sets: dict[str, Dataset] = {}

    def add(self, name: str, dataset: Dataset) -> None:
        self.sets[name.lower()] = dataset

    def paths(self, name: str, split: str = "test") -> tuple[str, str, str | None]:
        """(base, queries, truth); splits are what the data set has, such as train, valid, test, noisy."""
        if name.lower() not in self.sets:
            raise KeyError(f"no data set {name!r}; there are {sorted(self.sets)}")
        d = self.sets[name.lower()]
        if split not in d.queries:
            raise KeyError(f"{name} has no queries {split!r}; it has {sorted(d.queries)}")
        return d.base, d.queries[split], d.truth
