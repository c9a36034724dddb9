"""Approximate nearest neighbours by inner product: an inverted multi-index.

Vectors are cut into two halves, and each half is quantised with its own centroids, fitted on a bounded sample; their
number grows with the square root of the rows up to ``MOST``. A cell is a pair of centroids. A query walks the pairs
from the best summed inner product down, with a heap over blocks of the two sorted lists, until the cells hold ``need``
rows. What it needs for ``recall`` of the true neighbours is measured on the sample and on a quarter of it, and carried
on to the whole table at the power of the size that the two show. All rows of the walked cells are reranked on the
original vectors. How large a share that is depends on the data: unit vectors without structure need about a fifth.

Cells lie in shards of neighbouring first centroids, about ``chunk`` rows each; a larger shard is cut. A query goes, with
the sum at which its walk stopped, to the shards that it walked. A shard that more than ``block`` queries ask for is
copied once for each ``block`` of them, and no other, so copies never outweigh the queries. Of rows with the same
vector, only the k + 1 smallest ids can be among a query's k nearest, so an exact cut before the index keeps those (a
vector that a third of the rows share leaves each map task as k + 1 rows).

Vectors that are null, empty, zero, of another dimension than most, or hold null or non-finite components take no part.
Ties go to the smaller id. With fewer than k candidates a query gets all. Of query rows that repeat an id the least
vector is asked; of candidate rows that repeat an id the nearest counts. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tessera.llm._shared import Scratch, partitions

SAMPLE = 10_000
#: Centroids a half, at most; and centroids of each list in one block of the heap's.
MOST = 512
BLOCK = 32


@dataclass(frozen=True)
class Index:
    first: np.ndarray
    second: np.ndarray
    need: int


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from every (n/k)-th row in order of the first component."""
    k = min(k, len(x))
    c = x[np.argsort(x[:, 0], kind="stable")[(np.arange(k) * len(x)) // k]].copy()
    for _ in range(rounds):
        near = assign(x, c)
        counts = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def walk(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, need: int) -> float:
    """The sum a[i] + b[j] at which the cells from the best down hold ``need`` rows; ``sizes``: rows by i and j."""
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    sa, sb = a[ia], b[ib]
    heap, sums, rows, have, wait = [(-(sa[0] + sb[0]), 0, 0)], [], [], 0, 0
    while heap:
        _, i, j = heapq.heappop(heap)
        x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
        n = sizes[ia[x][:, None], ib[y]].ravel()
        sums.append((sa[x][:, None] + sb[y]).ravel()[n > 0])
        rows.append(n[n > 0])
        have += int(n.sum())
        if j + BLOCK < len(b):
            heapq.heappush(heap, (-(sa[i] + sb[j + BLOCK]), i, j + BLOCK))
        if j == 0 and i + BLOCK < len(a):
            heapq.heappush(heap, (-(sa[i + BLOCK] + sb[0]), i + BLOCK, 0))
        wait -= 1
        if have >= need and (wait <= 0 or not heap):  # cells above every block that is left count as walked
            s, r = np.concatenate(sums), np.concatenate(rows)
            by = np.argsort(-s, kind="stable")
            at = int(np.searchsorted(np.cumsum(r[by]), need))
            if not heap or s[by[at]] >= -heap[0][0]:
                return float(s[by[at]])
            sums, rows, wait = [s], [r], 8
    return -np.inf


def centroids_for(n: int, sample: int) -> int:
    return max(1, min(MOST, int(4 * n**0.5), -(-sample // 4)))


def _needed(x: np.ndarray, k: int, recall: float) -> float:
    """How many rows the walks over ``x`` have to hold so that ``recall`` of the true neighbours are among them."""
    half = x.shape[1] // 2
    c = centroids_for(len(x), len(x))
    first, second = kmeans(x[:, :half], c), kmeans(x[:, half:], c)
    i, j = assign(x[:, :half], first), assign(x[:, half:], second)
    needed = []
    for p in range(0, len(x), max(1, len(x) // 200)):
        scores = x @ x[p]
        scores[p] = -np.inf
        near = np.argpartition(-scores, min(k, len(scores)) - 1)[:k]
        sums = (first @ x[p, :half])[i] + (second @ x[p, half:])[j]
        needed.append(len(x) - np.searchsorted(np.sort(sums), sums[near]))
    return float(np.quantile(np.concatenate(needed), recall))


def fit(sample: np.ndarray, n: int, k: int, recall: float) -> Index:
    """For a table of ``n`` rows."""
    half = sample.shape[1] // 2
    c = centroids_for(n, len(sample))
    need, power = _needed(sample, k, recall), 1.0
    if n > 1.5 * len(sample):
        less = _needed(sample[::4], k, recall)
        power = float(np.clip(np.log(need / less) / np.log(4), 0.5, 1.0))
    first, second = kmeans(sample[:, :half], c), kmeans(sample[:, half:], c)
    axis = first - first.mean(axis=0)
    first = first[np.argsort(axis @ np.linalg.svd(axis, full_matrices=False)[2][0], kind="stable")]  # neighbours side by side
    return Index(first, second, int(np.ceil(need * max(1.0, n / len(sample)) ** power)))


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def search(
    df: DataFrame, queries: Column | None = None, k: int = 20, recall: float = 0.96, sample: int = SAMPLE, chunk: int = 8192, block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest rows of each row that ``queries`` (a condition on ``id``) selects."""
    spark, s = df.sparkSession, Scratch(df.sparkSession, "imi")
    id_kind = df.schema[id_col].dataType.simpleString()
    result = f"query_id {id_kind}, rank int, {id_col} {id_kind}, score double"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & _valid(F.col("v"))).withColumn("v", F.col("v").cast("array<double>"))
    queries = F.col("id") % 20 == 0 if queries is None else queries
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == usual["dim"])
    n, dim, half = usual["count"], usual["dim"], usual["dim"] // 2

    by_vector = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("__rank", F.row_number().over(by_vector)).where(f"__rank <= {k + 1}").drop("__rank")
    drawn = rows.where(F.xxhash64(F.lit(5), "id").bitwiseAND(2**31 - 1) < int(min(1.0, sample / n) * 2**31)).select("v").limit(2 * sample)
    train = np.array(sorted(r["v"] for r in drawn.collect()) or [r["v"] for r in rows.select("v").limit(sample).collect()])
    train = train[np.random.default_rng(0).permutation(len(train))]
    if half == 0:
        train = np.repeat(train, 2, axis=1)
    index = spark.sparkContext.broadcast(fit(train, n, k, recall))
    width = len(index.value.second)

    def halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
        return (x, x, x) if half == 0 else (x, x[:, :half], x[:, half:])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, p, q = halves(b.column(1))
                i, j = assign(p, index.value.first), assign(q, index.value.second)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["id", "x", "i", "j"])

    placed = s.write(kept.mapInArrow(place, f"id {id_kind}, x binary, i int, j int"))
    sizes = np.zeros((len(index.value.first), width), np.int64)
    for r in placed.groupBy("i", "j").count().collect():  # at most MOST * MOST rows
        sizes[r["i"], r["j"]] = r["count"]
    by_first = sizes.sum(axis=1)
    shard_of = ((np.cumsum(by_first) - by_first) // chunk).astype(np.int32)
    shard_of = np.unique(shard_of, return_inverse=True)[1].astype(np.int32)
    chunks = -(-np.bincount(shard_of, weights=by_first).astype(np.int64) // chunk)
    shared = spark.sparkContext.broadcast((sizes, shard_of))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, shard_of = shared.value
        there = sizes.sum(axis=1) > 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, p, q = halves(batch.column(1))
            a, c = p @ index.value.first.T, q @ index.value.second.T
            low = np.array([walk(a[r], c[r], sizes, index.value.need) for r in range(len(x))])
            whose, shard = [], []
            for r in range(len(x)):
                own = np.unique(shard_of[there & (a[r] + c[r].max() >= low[r] - 1e-9)])
                whose.append(np.full(len(own), r))
                shard.append(own)
            whose = np.concatenate(whose)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), pa.array([x[r].tobytes() for r in whose], pa.binary()), pa.array(low[whose]), pa.array(np.concatenate(shard), pa.int32())], ["id", "x", "low", "shard"])

    asked = rows.where(queries).groupBy("id").agg(F.min("v").alias("v"))
    # by a hash of its own: Spark would take the aggregate's exchange for one by id, and put small ones into one task
    spread = asked.repartition(partitions(spark), F.xxhash64(F.lit(21), "id"))
    routed = s.write(spread.mapInArrow(route, f"id {id_kind}, x binary, low double, shard int"))
    load = np.ones(len(chunks), np.int64)
    for r in routed.groupBy("shard").count().collect():  # a row a shard
        load[r["shard"]] = -(-r["count"] // block)
    plan = s.write(spark.createDataFrame([(i, int(c), int(b)) for i, (c, b) in enumerate(zip(chunks, load, strict=True))], "shard int, chunks int, blocks int"))
    firsts = s.write(spark.createDataFrame([(i, int(x)) for i, x in enumerate(shard_of)], "i int, shard int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    some = lambda c, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(c)).cast("int")
    left = routed.join(plan, "shard").withColumn("block", some("blocks", 9)).withColumn("chunk", each("chunks")).select("id", "x", "low", "shard", "chunk", "block")
    right = placed.join(firsts, "i").join(plan, "shard").withColumn("chunk", some("chunks", 3)).withColumn("block", each("blocks")).select("id", "x", "i", "j", "shard", "chunk", "block")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", id_type), (id_col, id_type), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        right = right.sort_by("id")
        q, x = (np.frombuffer(b"".join(t["x"].to_pylist()), np.float64).reshape(t.num_rows, dim) for t in (left, right))
        ids, at, i, j = right["id"].combine_chunks(), np.arange(right.num_rows), right["i"].to_numpy(), right["j"].to_numpy()
        first_of_id = np.array([n == 0 or ids[n] != ids[n - 1] for n in range(len(ids))])
        number = np.cumsum(first_of_id) - 1  # equal ids share one
        whole = first_of_id.all()
        asks, low = left["id"].combine_chunks(), left["low"].to_numpy()
        p = q if half == 0 else q[:, :half]
        a, c = p @ index.value.first.T, (q if half == 0 else q[:, half:]) @ index.value.second.T
        place = pc.index_in(asks, ids.filter(pa.array(first_of_id))).fill_null(-1).to_numpy()
        whose, found, scores = [], [], []
        for r in range(len(q)):
            own = at[(a[r, i] + c[r, j] >= low[r] - 1e-9) & (number != place[r])]
            if not own.size:
                continue
            near = x[own] @ q[r]
            if own.size > k and whole:
                slack = 1e-12 * np.linalg.norm(q[r]) * np.linalg.norm(x[own], axis=1).max()
                own = own[near >= np.partition(near, own.size - k)[own.size - k] - 2 * slack]
            exact = (q[r] * x[own]).sum(axis=1)
            best = np.lexsort((own, -exact))
            if not whole:
                best = best[np.sort(np.unique(number[own[best]], return_index=True)[1])]
            best = best[:k]
            whose.append(np.full(len(best), r))
            found.append(own[best])
            scores.append(exact[best])
        if not found:
            return kinds.empty_table()
        return pa.table([asks.take(pa.array(np.concatenate(whose))), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], schema=kinds)

    id_type = to_arrow_type(df.schema[id_col].dataType)
    keys = ["shard", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rerank, f"query_id {id_kind}, {id_col} {id_kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    found = found.groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int"), id_col, "score")
