import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Layout, QueryType, SearchConfig
from tessera.sources.memory import from_numpy
from tessera.streaming.runs import RunStore, standing_range, stream_into, windowed_counts
from tests.brute import check_range, check_top_k

LAYOUT = Layout(segments=4, bits=4)


def test_inserts_flushes_merges_and_windows(spark, tmp_path):
    r = np.random.default_rng(677)
    x = r.integers(-3, 4, size=(120, 12)).astype(np.float32)
    store = RunStore(spark, str(tmp_path / "s"), buffer=25)
    with pytest.raises(RuntimeError):
        store.insert(x[0])
    store.create(from_numpy(spark, x[:30]), LAYOUT)
    with pytest.raises(ValueError):
        store.create(from_numpy(spark, x[:30]), LAYOUT)
    store.insert(x[30])
    check_top_k(store.search(x[30:31], SearchConfig(k=31)).collect(), x[30:31], x[:31], 31)
    for a, b in ((31, 60), (60, 61), (61, 100)):
        store.insert_batch(x[a:b])
    store.insert_batch(x[100:])
    assert store.size() == 120
    for bad in (np.zeros((1, 11)), np.full((1, 12), np.nan)):
        with pytest.raises(ValueError):
            store.insert_batch(bad)
    q = x[[0, 50, 119]]
    check_top_k(store.search(q, SearchConfig(k=9)).collect(), q, x, 9)
    check_range(store.search(q, SearchConfig(r=16.0, type=QueryType.RANGE)).collect(), q, x, 16.0)
    for w in (1, 7, 60, 500):
        got = store.search_recent(q, 5, w).collect()
        assert len(got) == 3 * min(5, w) and all(g["id"] >= 120 - w for g in got)
    store.flush()
    store.compact()
    runs = store.runs()
    assert all(a.last_id + 1 == b.first_id for a, b in zip(runs, runs[1:], strict=False)) and all(a.level != b.level for a, b in zip(runs, runs[1:], strict=False))
    assert sum(n.rows for n in runs) == 120 and store.stats()["buffered_rows"] == 0
    store.vacuum()
    again = RunStore(spark, str(tmp_path / "s"))
    assert again.runs() == runs and store.stats()["bytes_written"] > 0
    check_top_k(again.search(q, SearchConfig(k=9)).collect(), q, x, 9)
    check_range(again.search(q, SearchConfig(r=16.0, type=QueryType.RANGE)).collect(), q, x, 16.0)
    again.insert(x[3])
    more = np.concatenate([x, x[3:4]])
    check_top_k(again.search(x[3:4], SearchConfig(k=4)).collect(), x[3:4], more, 4)
    again.flush()
    check_top_k(RunStore(spark, str(tmp_path / "s")).search(x[3:4], SearchConfig(k=121)).collect(), x[3:4], more, 121)
    check_top_k(store.search(q, SearchConfig(k=9)).collect(), q, x, 9)


def test_stream_is_appended_once_and_in_order(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(90, 12)).astype(np.float32)
    store = RunStore(spark, str(tmp_path / "s"))
    store.create(from_numpy(spark, x[:30]), LAYOUT)
    rest = from_numpy(spark, x[30:], 30).withColumnRenamed("id", "seq")
    for i in range(3):
        rest.where((F.col("seq") >= 30 + 20 * i) & (F.col("seq") < 50 + 20 * i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rest.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_into(store, stream, str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert store.size() == 90
    store.append_batch(rest, 0)  # a replay
    assert store.size() == 90
    check_top_k(store.search(x[:3], SearchConfig(k=5)).collect(), x[:3], x, 5) if [r.id for r in store.series().orderBy("id").collect()] == list(range(90)) else pytest.fail("ids")


def test_standing_queries(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(50, 8)).astype(np.float32)
    from_numpy(spark, x).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, series array<float>").parquet(str(tmp_path / "in"))
    out = standing_range(stream, x[:2], SearchConfig(r=10.0, type=QueryType.RANGE)).writeStream.format("memory").queryName("hits").start()
    out.processAllAvailable()
    out.stop()
    check_range(spark.table("hits").collect(), x[:2], x, 10.0)


def test_event_time_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) AS ts, cast(id % 2 AS string) AS key FROM range(120)").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "e"))
    out = windowed_counts(stream, "1 hour").writeStream.format("memory").outputMode("complete").queryName("counts").start()
    out.processAllAvailable()
    out.stop()
    assert sorted((r.key, r.n) for r in spark.table("counts").collect()) == [("0", 30), ("0", 30), ("1", 30), ("1", 30)]
