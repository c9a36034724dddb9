"""Appends, stored runs, series from events, generators and file names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Layout, SearchConfig
from tessera.functions import columns
from tessera.operators import search
from tessera.plans import index
from tessera.queries.searches import K, RANGE_SQL, RECENT_SQL, TOP, TOP_SQL, WINDOW, WITHIN
from tessera.queries.tables import asked, in_blocks, queries, rounded, series, table
from tessera.sources import files, memory
from tessera.streaming.runs import RunStore, stream_into

DAYS, FIRST_DAY = 30, "2024-01-01"


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        import uuid

        return f"{root.rstrip('/')}/runs-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-runs-")


def insert_then_top_k(spark: SparkSession, d: str) -> DataFrame:
    """An index over two thirds of the rows gets the rest appended; the answer is that of the whole table."""
    s = series(spark, d)
    old = s.where(F.col("id") % 3 != 2)
    i = index.append(index.build(old, "isax", Layout(segments=16, bits=4, leaf_size=50)), s.where(F.col("id") % 3 == 2))
    return rounded(in_blocks(queries(spark, d), lambda q: index.search(i, q, TOP)))


def streamed(spark: SparkSession, d: str, config: SearchConfig = TOP) -> DataFrame:
    """The first 100 vectors make a store; the others arrive by a stream that is stopped and started again, runs are merged,
    and the store is searched after it was opened anew."""
    folder = _folder(spark)
    s = series(spark, d)
    store = RunStore(spark, f"{folder}/store")
    store.create(s.where("id < 100"), Layout(segments=16, bits=4))
    arriving = s.where("id >= 100").select(F.col("id").alias("seq"), "series")
    last = s.agg(F.max("id")).first()[0]
    size = max(1, -(-(last - 99) // 3))
    for i in range(3):  # a third of the ids makes a micro-batch
        arriving.where((F.col("seq") >= 100 + i * size) & (F.col("seq") < 100 + (i + 1) * size)).write.mode("append").parquet(f"{folder}/arriving")
        stream = spark.readStream.schema(arriving.schema).parquet(f"{folder}/arriving")
        query = stream_into(store, stream, f"{folder}/checkpoint")
        query.processAllAvailable()
        query.stop()
    reopened = RunStore(spark, f"{folder}/store")
    return rounded(in_blocks(queries(spark, d), lambda q: reopened.search(q, config)))


def streamed_range(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, WITHIN)


def streamed_recent(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of the last rows that arrived."""
    folder, s = _folder(spark), series(spark, d)
    store = RunStore(spark, f"{folder}/store")
    store.create(s.where("id < 100"), Layout(segments=16, bits=4))
    store.append_batch(s.where("id >= 100").select(F.col("id").alias("seq"), "series"), 0)
    reopened = RunStore(spark, f"{folder}/store")
    return rounded(in_blocks(queries(spark, d), lambda q: reopened.search_recent(q, K, WINDOW)))


def user_series(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums of each user's values, z-normalized: one series a user."""
    day = F.datediff(F.col("ts"), F.lit(FIRST_DAY)).alias("day")
    daily = table(spark, d, "events").groupBy("user_id", day).agg(F.sum("value").alias("v")).where(F.col("day").between(0, DAYS - 1))
    by_day = F.map_from_entries(F.collect_list(F.struct("day", "v")))  # at most DAYS entries a user
    dense = F.transform(F.sequence(F.lit(0), F.lit(DAYS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    s = daily.groupBy("user_id").agg(by_day.alias("m")).select(F.col("user_id").alias("id"), columns.z_normalize(dense).alias("series"))
    return s


def user_series_top_k(spark: SparkSession, d: str) -> DataFrame:
    s = user_series(spark, d)
    q = s.where(asked()).select(F.col("id").alias("qid"), F.col("series").alias("q"))
    return rounded(in_blocks(q, lambda b: search.search(s, b, SearchConfig(k=5))))


USER_SQL = f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events), g AS (SELECT id, i FROM u, range(0, {DAYS}) t(i)),
s AS (SELECT user_id AS id, date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) AS i, sum(value) AS v FROM events GROUP BY ALL),
e AS (SELECT g.id, g.i, coalesce(s.v, 0) AS v FROM g LEFT JOIN s ON g.id = s.id AND g.i = s.i), m AS (SELECT id, avg(v) AS m, stddev_pop(v) AS d FROM e GROUP BY id),
z AS (SELECT e.id, i, CASE WHEN d > 0 THEN (v - m) / d ELSE 0 END AS v FROM e JOIN m ON e.id = m.id),
d AS (SELECT a.id AS qid, b.id, sum((a.v - b.v) * (a.v - b.v)) AS dist FROM z a JOIN z b ON a.i = b.i WHERE a.id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d) SELECT qid, rank, id, round(dist, 6) AS dist FROM r WHERE rank <= 5"""


def sinusoids(spark: SparkSession, d: str) -> DataFrame:
    return rounded(memory.sinusoids(spark, 20, 64).select("id", F.posexplode("series").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 4)))


SINUSOID_SQL = "SELECT id, i, round(round(CAST(sin(i * 0.07 + 0.013 * id) + cos(i * 0.19 - 0.013 * id) * 0.5 AS FLOAT)::DOUBLE, 4), 6) AS v FROM range(0, 20) a(id), range(0, 64) b(i)"


def random_is_normal(spark: SparkSession, d: str) -> DataFrame:
    """Generated series have mean 0 and deviation 1."""
    s = memory.random_series(spark, 50, 64, seed=7).select("id", F.col("series").alias("s"))
    return s.select("id", (F.round(columns.mean(F.col("s")), 4) + 0.0).alias("mean"), F.round(columns.deviation(F.col("s")), 4).alias("deviation"))


NORMAL_SQL = "SELECT id, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS deviation FROM range(0, 50) t(id)"


def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    names = ["astronomy_len256_size50K_q100_k10.bin", "walk_ctrl_len96_size2M.bin", "plain.bin", "seismic_len128_size300_q5_k1.bin"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    m = df.select("name", files.file_metadata(F.col("name")).alias("m"))
    return m.select("name", "m.is_control", *(F.coalesce(F.col(f"m.{c}").cast("long"), F.lit(-1)).alias(c) for c in ("dim", "n", "n_query", "k")))


METADATA_SQL = """SELECT * FROM (VALUES ('astronomy_len256_size50K_q100_k10.bin', 256::BIGINT, 50000::BIGINT, false, 100::BIGINT, 10::BIGINT), ('walk_ctrl_len96_size2M.bin', 96, 2000000, true, -1, -1),
('plain.bin', -1, -1, false, -1, -1), ('seismic_len128_size300_q5_k1.bin', 128, 300, false, 5, 1)) t(name, dim, n, is_control, n_query, k)"""


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """An exact number of distinct rows."""
    return memory.sample(series(spark, d), 40).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


QUERIES = {
    "insert_then_topk": (insert_then_top_k, TOP_SQL), "streamed_topk": (streamed, TOP_SQL), "streamed_range": (streamed_range, RANGE_SQL), "streamed_recent": (streamed_recent, RECENT_SQL), "user_series_topk": (user_series_top_k, USER_SQL), "sinusoid_source": (sinusoids, SINUSOID_SQL),
    "random_source": (random_is_normal, NORMAL_SQL), "file_metadata": (file_metadata, METADATA_SQL), "sample_rows": (sampled, "SELECT CAST(40 AS BIGINT) AS n, CAST(40 AS BIGINT) AS ids"),
}
