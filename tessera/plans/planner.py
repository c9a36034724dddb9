"""Which strategy a search should use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.config import DistanceType, Layout, QueryType, SearchConfig
from tessera.operators import search as exhaustive
from tessera.plans import index as indexes

#: Under this many rows a scan is done before an index is built.
SMALL = 1_000_000


def choose(n: int, config: SearchConfig, layout: Layout, searches: int = 1) -> str:
    """``exhaustive`` for small tables or single searches; else an index whose bounds hold for the metric."""
    if n < SMALL or searches < 2:
        return "exhaustive"
    if config.distance is DistanceType.DTW:
        return "isax"
    return "zorder" if layout.normalized or config.type is QueryType.TOP_K else "eapca"


def search(series: DataFrame, queries, config: SearchConfig, layout: Layout | None = None, strategy: str | None = None) -> DataFrame:
    """One search by the named or chosen strategy; the rows don't depend on it."""
    layout = layout or Layout()
    strategy = strategy or choose(series.count(), config, layout)
    if strategy == "exhaustive":
        return exhaustive.search(series, queries, config)
    return indexes.search(indexes.build(series, strategy, layout), queries, config)
