"""A log-structured store of series: appended batches become sorted runs, runs of one level are merged.

A store is a folder: ``runs/<n>`` are immutable Parquet tables sorted by the z-order key, and ``manifest/<version>``
lists the runs of a version as (run, level, first_id, last_id, rows, batch). ``summary`` holds the layout and the
breakpoints, so a store that is opened again goes on. A version is written in one commit, and a reader keeps the version
it began with. One writer at a time.

A search cuts the runs' keys into nodes, once a version; it seeds its limits in the nearest nodes, reads the words of
the nodes that are left, and then the series of the rows that their words leave. What is still buffered is scanned.

Levels count merges: two neighbouring runs of one level become one of the next, so neighbours in a level are
neighbours in time and a window over the last ids reads few runs.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import Layout, QueryType, SearchConfig
from tessera.operators import search as exhaustive
from tessera.operators.validate import check_series
from tessera.plans import index as indexes

_MANIFEST = "run int, level int, first_id long, last_id long, rows long, batch long"
_SUMMARY = "layout string, dim int, cuts array<double>, shape array<int>"


@dataclass(frozen=True)
class Run:
    run: int
    level: int
    first_id: int
    last_id: int
    rows: int
    batch: int = -1


class RunStore:
    """Create with the first rows (breakpoints are learned there once), then insert, search, compact."""

    def __init__(self, spark: SparkSession, path: str, buffer: int = 1_000_000):
        self.spark, self.path, self.buffer = spark, path.rstrip("/"), buffer
        self.summary: indexes.Summary | None = None
        self.counters = {"flushes": 0, "merges": 0, "bytes_written": 0, "runs_skipped": 0}
        self.pending: list[DataFrame] = []
        self.pending_rows = 0
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version = max((int(s.getPath().getName()) for s in self._list(f"{self.path}/manifest")), default=0)
        self._index: tuple[int, indexes.Index] | None = None
        if self.version:
            self.summary = self._summary()

    def _summary(self) -> indexes.Summary:
        r = self.spark.read.schema(_SUMMARY).parquet(f"{self.path}/summary").first()
        return indexes.Summary("zorder", Layout(**json.loads(r["layout"])), r["dim"], np.array(r["cuts"]).reshape(r["shape"]))

    def _save_summary(self) -> None:
        s = self.summary
        row = (json.dumps(asdict(s.layout)), s.dim, [float(c) for c in s.cuts.ravel()], list(s.cuts.shape))
        self.spark.createDataFrame([row], _SUMMARY).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/summary")

    def _list(self, folder: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def runs(self) -> list[Run]:
        if not self.version:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{self.version}").collect()
        return sorted((Run(*r) for r in rows), key=lambda r: r.first_id)

    def _commit(self, runs: list[Run]) -> None:
        rows = [(r.run, r.level, r.first_id, r.last_id, r.rows, r.batch) for r in runs]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{self.version + 1}")
        self.version += 1

    def _write(self, rows: DataFrame, number: int) -> None:
        path = f"{self.path}/runs/{number}"
        rows.repartitionByRange("key").sortWithinPartitions("key", "id").write.mode("overwrite").parquet(path)
        self.counters["bytes_written"] += self._fs.getContentSummary(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)).getLength()

    # building and inserting

    def create(self, series: DataFrame, layout: Layout | None = None) -> None:
        if self.version:
            raise ValueError("the store exists; its layout can't change")
        layout = layout or Layout()
        n, dim = check_series(series)
        if not n:
            raise ValueError("a store begins with at least one series")
        layout.check(dim, "zorder")
        self.summary = indexes.learn(series, "zorder", layout, dim, n)
        self._save_summary()
        self._flush(series, batch=-1)

    def size(self) -> int:
        return sum(r.rows for r in self.runs()) + self.pending_rows

    def insert(self, x: np.ndarray) -> None:
        """One series."""
        self.insert_batch(np.asarray(x)[None])

    def insert_batch(self, x: np.ndarray) -> None:
        """Rows of a 2-D array; they get the next ids, and the next search sees them. All or none is taken."""
        from tessera.sources.memory import from_numpy

        self._need()
        x = np.asarray(x, dtype=np.float32)
        if x.ndim != 2 or (len(x) and x.shape[1] != self.summary.dim):
            raise ValueError(f"series must have length {self.summary.dim}")
        if not np.isfinite(x).all():
            raise ValueError("series must be finite")
        if not len(x):
            return
        self.pending.append(from_numpy(self.spark, x, self.size()))
        self.pending_rows += len(x)
        if self.pending_rows >= self.buffer:
            self.flush()
            self.compact()

    def flush(self) -> None:
        """Writes what is buffered as a run."""
        if self.pending:
            whole = self.pending[0]
            for p in self.pending[1:]:
                whole = whole.unionByName(p)
            self.pending, self.pending_rows = [], 0
            self._flush(whole, batch=-1)

    def _need(self) -> None:
        if self.summary is None:
            raise RuntimeError("create the store before inserting or searching")

    def _flush(self, series: DataFrame, batch: int) -> None:
        runs = self.runs()
        number = max((r.run for r in runs), default=-1) + 1 + len([s for s in self._list(f"{self.path}/runs")])
        self._write(indexes.encode(series, self.summary), number)
        s = self.spark.read.parquet(f"{self.path}/runs/{number}").agg(F.min("id"), F.max("id"), F.count("*")).first()
        self.counters["flushes"] += 1
        self._commit([*runs, Run(number, 0, s[0], s[1], s[2], batch)])

    def append_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: appends (seq, series) in the order of seq. A batch that was committed before is skipped."""
        self._need()
        self.flush()
        if any(r.batch >= batch_id >= 0 for r in self.runs()):
            return
        n, dim = check_series(batch)
        if not n:
            return
        if dim != self.summary.dim:
            raise ValueError(f"series must have length {self.summary.dim}")
        base = self.size()
        # ids must be consecutive, so the rank is global; per-partition counts first keep one task from holding the batch
        spread = batch.select("seq", "series").repartitionByRange("seq").withColumn("part", F.spark_partition_id()).cache()
        sizes = spread.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
        ranked = spread.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("seq")))
        numbered = ranked.join(F.broadcast(sizes), "part").select((F.col("before") + F.col("place") - 1 + base).cast("long").alias("id"), "series")
        self._flush(numbered, batch_id)
        spread.unpersist()
        self.compact()

    # compaction

    def compact(self) -> None:
        """Merges neighbouring runs of one level until no two are left."""
        while True:
            runs = self.runs()
            pair = next(((a, b) for a, b in zip(runs, runs[1:], strict=False) if a.level == b.level), None)
            if pair is None:
                return
            a, b = pair
            number = 1 + max(int(s.getPath().getName()) for s in self._list(f"{self.path}/runs"))
            self._write(self._read([a, b]), number)
            self.counters["merges"] += 1
            merged = Run(number, a.level + 1, a.first_id, b.last_id, a.rows + b.rows, max(a.batch, b.batch))
            self._commit([r for r in runs if r not in pair] + [merged])

    def vacuum(self) -> None:
        """Deletes runs and manifests that the newest version doesn't name."""
        named = {str(r.run) for r in self.runs()}
        for s in self._list(f"{self.path}/runs"):
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
        for s in self._list(f"{self.path}/manifest"):
            if int(s.getPath().getName()) < self.version:
                self._fs.delete(s.getPath(), True)

    # searching

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema("id long, series array<float>, word binary, key binary").parquet(*(f"{self.path}/runs/{r.run}" for r in runs))

    def series(self, first_id: int = 0) -> DataFrame:
        """(id, series) from an id on; runs that end before aren't read."""
        use = [r for r in self.runs() if r.last_id >= first_id]
        self.counters["runs_skipped"] += len(self.runs()) - len(use)
        parts = ([self._read(use).select("id", "series")] if use else []) + self.pending
        whole = parts[0] if parts else self.spark.createDataFrame([], "id long, series array<float>")
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole.where(F.col("id") >= first_id)

    def search(self, queries, config: SearchConfig) -> DataFrame:
        self._need()
        config.check()
        if config.type is QueryType.TOP_K and config.k > self.size():
            raise ValueError("k is more than the number of series")
        runs = self.runs()
        stored = sum(r.rows for r in runs)
        if not runs or config.type is QueryType.TOP_K and config.k > stored:
            return exhaustive.search(self.series(), queries, config, self.size())
        if self._index is None or self._index[0] != self.version:
            self._index = (self.version, self._nodes(runs, stored))
        found = indexes.search(self._index[1], queries, config)
        if not self.pending:
            return found
        from tessera.operators.validate import as_queries

        qids, q = as_queries(queries, self.summary.dim)
        fresh = self.pending[0]
        for p in self.pending[1:]:
            fresh = fresh.unionByName(p)
        return exhaustive.finish(found.select("qid", "id", "dist").unionByName(exhaustive.scan(fresh, qids, q, config).select("qid", "id", "dist")), config)

    def _nodes(self, runs: list[Run], stored: int) -> indexes.Index:
        layout = self.summary.layout
        rows = self._read(runs)
        length = indexes._prefix_length(rows, layout, stored, -(-layout.segments * layout.bits // 8))
        rows = rows.withColumn("node", indexes.node(length))
        return indexes.Index(self.summary, rows.select("id", "series", "word", "node"), indexes._nodes(rows, self.summary), stored, length, not exhaustive.repeats(rows))

    def search_recent(self, queries, k: int, window: int) -> DataFrame:
        """Top-k among the last ``window`` series; fewer rows if fewer qualify."""
        self._need()
        if window < 1:
            raise ValueError("window must be at least 1")
        config = SearchConfig(k=k)
        config.check()
        from tessera.operators.validate import as_queries

        qids, q = as_queries(queries, self.summary.dim)
        recent = self.series(max(0, self.size() - window))
        return exhaustive.finish(exhaustive.scan(recent, qids, q, config), config)

    def stats(self) -> dict[str, int]:
        runs = self.runs()
        return {**self.counters, "runs": len(runs), "stored_rows": sum(r.rows for r in runs), "buffered_rows": self.pending_rows, "version": self.version}


def stream_into(store: RunStore, stream: DataFrame, checkpoint: str):
    """Starts appending a stream of (seq, series) to the store; a replayed micro-batch is not appended twice."""
    return stream.writeStream.foreachBatch(store.append_batch).option("checkpointLocation", checkpoint).start()


def standing_range(stream: DataFrame, queries, config: SearchConfig) -> DataFrame:
    """A stream of (qid, id, dist): arriving series within r of standing queries."""
    from tessera.operators.validate import as_queries

    config.check()
    qids, q = as_queries(queries)
    return exhaustive.scan(stream, qids, q, config)


def windowed_counts(stream: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time windows over (ts, key): counts by window and key, with a watermark for late rows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("window"), "key").agg(F.count("*").alias("n"))
