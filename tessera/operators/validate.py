"""Checks that all entry points share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries travel to every task, so a batch has a size limit; larger sets are answered batch by batch.
MOST_QUERY_BYTES = 64 << 20


def as_queries(queries: DataFrame | Sequence | np.ndarray, dim: int | None = None) -> tuple[list[int], np.ndarray]:
    """(qids, matrix) of a small set: a DataFrame (qid, q), or a 2-D array whose row numbers are the qids."""
    if isinstance(queries, DataFrame):
        width = queries.agg(F.sum(F.size("q") * 8), F.count("*"), F.sum(F.col("q").isNull().cast("int"))).first()
        if width[2]:
            raise ValueError("a query is null")
        if (width[0] or 0) > MOST_QUERY_BYTES:
            raise ValueError(f"queries are more than {MOST_QUERY_BYTES} bytes; search them batch by batch")
        rows = sorted((r["qid"], r["q"]) for r in queries.select("qid", "q").collect())
        ids, values = [r[0] for r in rows], [r[1] for r in rows]
    else:
        values = np.asarray(queries, dtype=np.float64)
        if values.ndim != 2:
            raise ValueError("queries must be a two-dimensional array")
        ids = list(range(len(values)))
    if not len(ids):
        raise ValueError("no queries")
    if len({len(v) for v in values}) != 1 or (dim is not None and len(values[0]) != dim):
        raise ValueError(f"queries must all have length {dim if dim is not None else len(values[0])}")
    matrix = np.array(values, dtype=np.float64)
    if not np.isfinite(matrix).all():
        raise ValueError("queries must be finite")
    return ids, matrix


def check_series(df: DataFrame) -> tuple[int, int]:
    """(rows, length) of a series table (id, series); raises if a row is null, of another length, or not finite."""
    bad = F.col("series").isNull() | F.exists("series", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = df.agg(F.count("*").alias("n"), F.min(F.size("series")).alias("lo"), F.max(F.size("series")).alias("hi"), F.sum(bad.cast("long")).alias("bad")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} series are null or not finite")
    if r["lo"] != r["hi"]:
        raise ValueError(f"series have lengths from {r['lo']} to {r['hi']}")
    return r["n"], r["hi"] or 0
