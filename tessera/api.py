"""The one object that answers everything: build, insert, search, whatever the strategy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DistanceType, Layout, QueryType, SearchConfig
from tessera.operators import search as exhaustive
from tessera.operators.validate import check_series
from tessera.plans import index as indexes
from tessera.sources.memory import from_numpy


class SeriesSearch:
    """Exact search by ``exhaustive`` scan or one of the index strategies; all give the same rows.

    >>> s = SeriesSearch(spark, "isax").build_index(x)      # a 2-D array or a DataFrame (id, series)
    >>> ids, dists = s.search_index(q, k=10)                # arrays of queries x k
    >>> ids, dists = s.search_index(q, SearchConfig(r=2.0, type=QueryType.RANGE))  # lists, one a query
    """

    def __init__(self, spark: SparkSession, strategy: str = "exhaustive", layout: Layout | None = None, distance: DistanceType = DistanceType.L2_SQUARED, band: int | None = None):
        if strategy != "exhaustive" and strategy not in indexes.STRATEGIES:
            raise ValueError(f"strategy must be exhaustive or one of {indexes.STRATEGIES}")
        self.spark, self.strategy, self.layout, self.distance, self.band = spark, strategy, layout or Layout(), distance, band
        self.series: DataFrame | None = None
        self.index: indexes.Index | None = None
        self.n = self.dim = 0

    def build_index(self, data: DataFrame | np.ndarray) -> SeriesSearch:
        if self.series is not None:
            raise RuntimeError("the index is built")
        series = data if isinstance(data, DataFrame) else from_numpy(self.spark, data)
        self.n, self.dim = check_series(series)
        if not isinstance(data, DataFrame):
            self.dim = np.shape(data)[1]
        self.series = series
        if self.strategy != "exhaustive" and self.n:
            self.index = indexes.build(series, self.strategy, self.layout)
        return self

    def insert(self, x: Sequence[float]) -> None:
        self.insert_batch(np.asarray(x)[None])

    def insert_batch(self, x: np.ndarray) -> None:
        """Rows get the next ids and are seen by the next search; nothing is taken if one is wrong."""
        self._need()
        x = np.asarray(x, dtype=np.float32)
        if x.ndim != 2 or (len(x) and x.shape[1] != self.dim):
            raise ValueError(f"series must have length {self.dim}")
        if not np.isfinite(x).all():
            raise ValueError("series must be finite")
        if not len(x):
            return
        first = 1 + (self.series.agg(F.max("id")).first()[0] if self.n else -1)
        rows = from_numpy(self.spark, x, first)
        if self.index is not None:
            self.index = indexes.append(self.index, rows)
        self.series = self.series.select(F.col("id").cast("long").alias("id"), "series").unionByName(rows)
        if self.index is None and self.strategy != "exhaustive":
            self.index = indexes.build(self.series, self.strategy, self.layout)
        self.n += len(x)

    def _need(self) -> None:
        if self.series is None:
            raise RuntimeError("build the index first")

    def result(self, queries, config: SearchConfig) -> DataFrame:
        """(qid, rank, id, dist), or for a range (qid, id, dist)."""
        self._need()
        if self.index is not None:
            return indexes.search(self.index, queries, config)
        return exhaustive.search(self.series, queries, config, self.n)

    def search_index(self, queries, k: int | SearchConfig):
        """Arrays of (queries, k) for top-k; lists of arrays, one a query, for a range."""
        config = k if isinstance(k, SearchConfig) else SearchConfig(k=k, distance=self.distance, band=self.band)
        rows = self.result(queries, config).collect()
        qids = sorted(r["qid"] for r in queries.select("qid").collect()) if isinstance(queries, DataFrame) else list(range(len(queries)))
        by = {q: [] for q in qids}
        for r in sorted(rows, key=lambda r: (r["qid"], r["dist"], r["id"])):
            by[r["qid"]].append((r["id"], r["dist"]))
        ids = [np.array([i for i, _ in by[q]], np.int64) for q in qids]
        dists = [np.array([d for _, d in by[q]]) for q in qids]
        return (np.array(ids), np.array(dists)) if config.type is QueryType.TOP_K else (ids, dists)

    def search_recent(self, queries, k: int, window: int) -> DataFrame:
        self._need()
        return exhaustive.recent_top_k(self.series, queries, k, window)

    def statistics(self) -> dict[str, float]:
        """Rows, nodes, and the sizes of the largest and the average node."""
        self._need()
        sizes = self.index.nodes["size"] if self.index is not None else np.array([self.n])
        return {"rows": self.n, "nodes": len(sizes), "largest": int(sizes.max(initial=0)), "average": float(sizes.mean()) if len(sizes) else 0.0}
