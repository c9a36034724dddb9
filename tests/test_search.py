import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.api import SeriesSearch
from tessera.config import DistanceType, Layout, QueryType, SearchConfig
from tessera.operators import search
from tessera.plans import index, planner
from tessera.sources.memory import from_numpy, queries_from_numpy
from tests.brute import check_range, check_top_k, dtw

ALL = ("exhaustive", *index.STRATEGIES)
LAYOUT = Layout(segments=8, bits=4, leaf_size=20, word_length=8)


def data(n=150, dim=32, seed=1):
    r = np.random.default_rng(seed)
    return np.cumsum(r.normal(size=(n, dim)), axis=1).astype(np.float32), np.cumsum(r.normal(size=(4, dim)), axis=1).astype(np.float32)


def in_range(r, **more):
    return SearchConfig(r=r, type=QueryType.RANGE, **more)


@pytest.mark.parametrize("strategy", ALL)
def test_every_strategy_is_exact(spark, strategy):
    x, q = data()
    s = SeriesSearch(spark, strategy, LAYOUT).build_index(x)
    check_top_k(s.result(q, SearchConfig(k=7)).collect(), q, x, 7)
    check_range(s.result(q, in_range(120.0)).collect(), q, x, 120.0)


@pytest.mark.parametrize("strategy", ["exhaustive", "isax", "sfa"])
def test_warping(spark, strategy):
    x, q = data(60, 24, 3)
    s = SeriesSearch(spark, strategy, LAYOUT).build_index(x)
    for band in (None, 5):
        metric = lambda a, b, w=2 if band is None else band: dtw(a, b, w)
        check_top_k(s.result(q, SearchConfig(k=4, distance=DistanceType.DTW, band=band)).collect(), q, x, 4, metric)
        check_range(s.result(q, in_range(60.0, distance=DistanceType.DTW, band=band)).collect(), q, x, 60.0, metric)


def test_range_is_inclusive(spark):
    x = np.zeros((3, 32), np.float32)
    x[1, :16], x[2, 8:16] = np.tile([1, -1], 8), np.tile([1, -1], 4)
    for strategy in ("exhaustive", "sax", "eapca"):
        s = SeriesSearch(spark, strategy, LAYOUT).build_index(x)
        assert [list(i) for i in s.search_index(np.zeros((1, 32)), in_range(0.0))[0]] == [[0]]
        assert [sorted(i) for i in s.search_index(np.zeros((1, 32)), in_range(8.0))[0]] == [[0, 2]]


def test_equal_summaries_and_ties_give_distinct_ids(spark):
    a = np.array([1.0, 1.0, *np.arange(3, 13)])
    x = (a[:, None] * np.tile([1, -1], 16)).astype(np.float32)
    s = SeriesSearch(spark, "isax", LAYOUT).build_index(x)
    more = (np.arange(13, 21)[:, None] * np.tile([1, -1], 16)).astype(np.float32)
    s.insert_batch(more)
    ids, dists = s.search_index(np.zeros((1, 32)), 20)
    assert list(ids[0]) == list(range(20))
    assert np.allclose(dists[0], np.concatenate((a, np.arange(13, 21))) ** 2 * 32)


def test_constant_rows_and_far_queries(spark):
    x = np.repeat(np.arange(-20, 21)[:, None], 64, axis=1).astype(np.float32)
    q = np.repeat(np.array([-100, -20, 0, 20, 100])[:, None], 64, axis=1).astype(np.float32)
    for strategy in ("exhaustive", "zorder", "multiary"):
        s = SeriesSearch(spark, strategy, LAYOUT).build_index(x)
        check_top_k(s.result(q, SearchConfig(k=5)).collect(), q, x, 5)
        check_range(s.result(q, in_range(64.0)).collect(), q, x, 64.0)


def test_inserts_are_visible_and_numbered(spark):
    r = np.random.default_rng(123)
    x = r.normal(size=(8, 32)).astype(np.float32)
    for strategy in ("exhaustive", "sax"):
        s = SeriesSearch(spark, strategy, LAYOUT).build_index(x[:3])
        s.insert(x[3])
        assert s.search_index(x[3:4], 1)[0][0][0] == 3
        s.insert_batch(x[4:])
        s.insert_batch(np.zeros((0, 32)))
        check_top_k(s.result(x, SearchConfig(k=8)).collect(), x, x, 8)
        with pytest.raises(ValueError):
            s.insert(np.zeros(31))
        with pytest.raises(ValueError):
            s.insert_batch(np.array([[np.nan] * 32]))
        assert s.n == 8


def test_build_on_nothing_then_insert(spark):
    s = SeriesSearch(spark, "isax", LAYOUT).build_index(np.zeros((0, 64), np.float32))
    s.insert_batch(np.ones((5, 64)))
    ids, dists = s.search_index(np.ones((1, 64)), 5)
    assert list(ids[0]) == [0, 1, 2, 3, 4] and not dists.any()


def test_errors(spark):
    x, q = data(16, 64, 3)
    for strategy in ("exhaustive", "isax"):
        s = SeriesSearch(spark, strategy, LAYOUT).build_index(x)
        assert sorted(s.search_index(q[:1], 16)[0][0]) == list(range(16))
        for bad in (17, 0, -1):
            with pytest.raises(ValueError):
                s.search_index(q, bad)
        for r in (-1.0, float("nan")):
            with pytest.raises(ValueError):
                s.search_index(q, in_range(r))
        with pytest.raises(ValueError):
            s.search_index(np.full((1, 64), np.inf), 1)
        with pytest.raises(ValueError):
            s.search_index(np.zeros(64), 1)
        with pytest.raises(ValueError):
            s.search_index(np.zeros((0, 64)), 1)
    with pytest.raises(ValueError):
        SeriesSearch(spark, "isax", LAYOUT).build_index(x).search_index(np.zeros((1, 63)), 1)
    with pytest.raises(RuntimeError):
        SeriesSearch(spark).insert(np.zeros(4))
    with pytest.raises(ValueError):
        SeriesSearch(spark).build_index(np.array([[1.0, np.nan]]))
    with pytest.raises(ValueError):
        SeriesSearch(spark, "sax", Layout(segments=65)).build_index(x)
    with pytest.raises(ValueError):
        SeriesSearch(spark, "other")


def test_array_layouts(spark):
    x, q = data(40, 32, 5)
    s = SeriesSearch(spark).build_index(np.asfortranarray(x))
    want = s.search_index(q, 3)[0]
    for other in (np.asfortranarray(q), np.repeat(q, 2, axis=0)[::2], q[::-1][::-1]):
        assert (s.search_index(other, 3)[0] == want).all()


def test_recent_window(spark):
    r = np.random.default_rng(102)
    x = r.integers(-2, 3, size=(200, 12)).astype(np.float32)
    x[-1] = x[0]
    df = from_numpy(spark, x)
    for w in (1, 5, 17, 200, 500):
        got = search.recent_top_k(df, x[:1], 3, w).collect()
        assert len(got) == min(3, w) and all(g["id"] >= 200 - w for g in got)
        assert got[0]["id"] == (199 if w < 200 else 0)


def test_native_ragged_and_self(spark):
    x, q = data(50, 16, 8)
    df, qf = from_numpy(spark, x), queries_from_numpy(spark, q)
    check_top_k(search.search_native(df, qf, SearchConfig(k=5)).collect(), q, x, 5)
    check_range(search.search_native(df, qf, in_range(50.0)).collect(), q, x, 50.0)
    lists = {r.qid: r for r in search.ragged(search.top_k(df, qf, 5)).collect()}
    assert all(len(r.ids) == len(r.dists) == 5 and list(r.dists) == sorted(r.dists) for r in lists.values())
    own = search.without_self(df, df.select(F.col("id").alias("qid"), F.col("series").alias("q")).where("qid < 3"), SearchConfig(k=4)).collect()
    assert all(r["qid"] != r["id"] for r in own) and len(own) == 12


def test_planner(spark):
    x, q = data(50, 16, 8)
    assert planner.choose(10, SearchConfig(k=1), LAYOUT, 10) == "exhaustive"
    assert planner.choose(10**9, SearchConfig(k=1), LAYOUT, 10) in index.STRATEGIES
    for strategy in (None, "sfa"):
        check_top_k(planner.search(from_numpy(spark, x), q, SearchConfig(k=5), LAYOUT, strategy).collect(), q, x, 5)


def test_pruning_prunes(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 32)) * 5
    x = (np.repeat(centres, 50, axis=0) + r.normal(size=(1000, 32)) * 0.1).astype(np.float32)
    i = index.build(from_numpy(spark, x), "isax", Layout(segments=8, bits=4, leaf_size=50))
    assert index.candidate_pairs(i, x[:4], SearchConfig(k=5)) < 4 * 1000 / 3
    check_top_k(index.search(i, x[:4], SearchConfig(k=5)).collect(), x[:4], x, 5)


def test_index_search_shuffles_only_what_it_found(spark):
    x, q = data()
    for strategy in ("sax", "sfa", "eapca"):
        i = index.build(from_numpy(spark, x), strategy, LAYOUT)
        for config in (SearchConfig(k=7), in_range(120.0)):
            plan = index.search(i, q, config)._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan


def test_nodes_hold_about_a_leaf_and_bounds_are_made_in_parts(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(4000, 16)).astype(np.float32)
    for strategy in ("isax", "zorder"):
        i = index.build(from_numpy(spark, x), strategy, Layout(segments=16, bits=4, leaf_size=50))
        assert 40 <= len(i.nodes["key"]) <= 320 and i.nodes["size"].sum() == 4000
    i = index.append(i, from_numpy(spark, x[:10] + np.float32(0.5), 4000))
    assert len(i.nodes["key"]) <= 320
    monkeypatch.setattr(index, "MOST_BOUNDS", 100)
    check_top_k(index.search(i, x[:6], SearchConfig(k=5)).collect(), x[:6], np.concatenate([x, x[:10] + np.float32(0.5)]), 5)


def test_blocks_of_rows_and_queries_lose_no_pair(spark, monkeypatch):
    x, q = data(300, 24, 11)
    q = np.concatenate([q, x[:3]])
    for name, size in (("ROWS", 37), ("QUERIES", 3), ("PAIRS", 50), ("FIRST", 2)):
        monkeypatch.setattr(search, name, size)
    for scale in (1e-6, 1.0, 1e18):
        y, p = (x * np.float32(scale)), (q * np.float32(scale)).astype(np.float64)
        for metric, config in (("l2", SearchConfig(k=6)), ("dtw", SearchConfig(k=6, distance=DistanceType.DTW, band=3))):
            meter, best, found = search.Meter(p, config), search.Best(len(p), 6), set()
            r = dtw(p[0], y[5], 3 if metric == "dtw" else 0) * (1 + 1e-9)
            for a in range(0, 300, 37):
                block = search.Block(y[a : a + 37].astype(np.float64))
                of, rows = search._may_be_near(meter, None, None, block, 0, best.bound)
                of, rows, dist = meter.within(of, rows, block, best.bound)
                best.add(of, rows + a, dist)
                limits = np.full(len(p), r)
                of, rows, _ = meter.within(*search._may_be_near(meter, None, None, block, 0, limits), block, limits)
                found |= set(zip(of.tolist(), (rows + a).tolist(), strict=True))
            for i in range(len(p)):
                far = sorted((dtw(p[i], v, 3 if metric == "dtw" else 0), j) for j, v in enumerate(y))
                assert [j for _, j in far[:6]] == best.ids[best.of == i].tolist()
                assert {j for d, j in far if d <= r} == {j for k, j in found if k == i}


def test_native_top_k_sorts_few_pairs_of_each_query(spark):
    x = np.random.default_rng(21).integers(-2, 3, size=(900, 12)).astype(np.float32)  # many ties
    df, qf = from_numpy(spark, x), queries_from_numpy(spark, x[:5])
    got = search.search_native(df, qf, SearchConfig(k=9))
    assert "NestedLoop" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan and "MapInArrow" not in plan
    want = [(i, k + 1, *sorted((float(((v - x[i]) ** 2).sum()), j) for j, v in enumerate(x))[k][::-1]) for i in range(5) for k in range(9)]
    assert sorted(map(tuple, got.collect())) == want
    few = search.search_native(df.where("id < 4"), qf, SearchConfig(k=9)).collect()  # fewer rows than k
    assert len(few) == 20


@pytest.mark.parametrize("dim", [24, 130])
def test_native_range_loses_no_pair_at_any_scale(spark, dim):
    x, _ = data(80, dim, 12)
    for scale in (1e-6, 1.0, 1e15):
        y = x * np.float32(scale)
        df, qf = from_numpy(spark, y), queries_from_numpy(spark, y[:3])
        dist = [[float(np.cumsum((v.astype(float) - y[i].astype(float)) ** 2)[-1]) for v in y] for i in range(3)]
        for r in (0.0, dist[0][7], 1e300):
            got = search.search_native(df.unionByName(df.limit(1).selectExpr("99L AS id", "CAST(NULL AS array<float>) AS series")), qf, in_range(r))
            assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, got.collect())) == [(i, j, d) for i in range(3) for j, d in enumerate(dist[i]) if d <= r]


@pytest.mark.parametrize("strategy", [None, "isax", "eapca"])
def test_range_exchanges_no_pair_unless_ids_repeat(spark, strategy):
    x, q = data(200, 16, 13)
    df = from_numpy(spark, x)
    for series in (df, df.unionByName(df.where("id < 50"))):
        found = planner.search(series, q, in_range(40.0), LAYOUT, strategy or "exhaustive")
        exchanged = "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()
        assert exchanged == (series is not df)
        rows = found.collect()
        check_range(rows, q, x, 40.0)
        assert len(rows) == len({(r["qid"], r["id"]) for r in rows}) > 0


def test_a_worker_prepares_many_queries_in_little_memory():
    import tracemalloc

    r = np.random.default_rng(6)
    q, layout = r.normal(size=(20_000, 32)), Layout(segments=16, bits=4)
    words = np.zeros((1, 16))
    for strategy in ("multiary", "eapca"):
        summary = index.Summary(strategy, layout, 32, np.zeros(16) if strategy == "eapca" else np.linspace(-1, 1, 15))
        nodes = {"key": np.array([b""], object), "size": np.array([1]), "low": words, "high": words}
        tracemalloc.start()
        index.Pruner(summary, nodes, in_range(1.0)).start(q)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 80e6


@pytest.mark.parametrize("band", [0, 3, 40])
@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e3])
def test_tiles_of_rows_leave_few_pairs_and_lose_none(monkeypatch, band, scale):
    r = np.random.default_rng(31)
    x = r.normal(size=(2500, 24)) * scale
    x[7], x[8], x[9] = 0, x[11] * (1 + 1e-9), x[11]
    x[10, 3] *= 40  # cut at the ends of the integers
    q, warped, warp = np.concatenate([x[7:12], r.normal(size=(4, 24)) * scale]), [], search.kernels.warp
    want = np.stack([search.kernels.dtw(v, x, band) for v in q])
    monkeypatch.setattr(search.kernels, "warp", lambda a, b, *c: warped.append(b.shape[1]) or warp(a, b, *c))
    for rank, integers in ((0, True), (3, True), (3, False), (60, True), (60, False)):
        meter, block = search.Meter(q, in_range(1.0, distance=DistanceType.DTW, band=band)), search.Block(x)
        meter.integers_help = integers
        limits, warped[:] = np.sort(want, axis=1)[:, rank] * (1 + 1e-9), []
        of, rows = search._may_be_near(meter, None, None, block, 0, limits)
        of, rows, dist = meter.within(of, rows, block, limits)
        assert sorted(zip(of.tolist(), rows.tolist(), strict=True)) == [(i, j) for i, d in enumerate(want) for j in np.flatnonzero(d <= limits[i])]
        assert (dist == want[of, rows]).all()
        assert sum(warped) < 0.4 * want.size


@pytest.mark.parametrize("m", [1, 2, 5, 40, 1500])
def test_integers_bound_warping_from_below(m):
    r = np.random.default_rng(m)
    for top in (1e-200, 0.3, 1e15):
        x, q = r.normal(size=(600, m)), r.normal(size=m)
        x, q = x * (top / np.abs(x).max()), q * (top / np.abs(q).max())
        want = search.kernels.dtw(q, x, 3)
        for limit in (0.0, want.min(), np.median(want), want.max() * 10, 1e300):
            scale, most = search.kernels.integer_scale(limit, top, m)
            assert (scale == 0) == (m == 1500) and most < search.kernels.Tile.FULL
            if scale:
                tile = search.kernels.Tile(np.ascontiguousarray(search.kernels.integers(x, scale).T[::-1]), 3)
                assert tile.within(search.kernels.integers(q, scale), most)[want <= limit].all()


def test_warping_searches_over_blocks_of_many_rows(spark):
    r = np.random.default_rng(32)
    x = r.normal(size=(6000, 16)).astype(np.float32)
    x[:40] = x[100]  # ties go to the smaller id
    q, df = x[90:104], from_numpy(spark, x).coalesce(1)
    want = [search.kernels.dtw(v.astype(float), x.astype(float), 3) for v in q]
    built = index.build(df, "zorder", LAYOUT)
    for run in (lambda c: search.search(df, q, c), lambda c: index.search(built, q, c)):
        got = sorted((a["qid"], a["rank"], a["id"]) for a in run(SearchConfig(k=5, distance=DistanceType.DTW, band=3)).collect())
        assert got == [(i, k + 1, int(j)) for i, d in enumerate(want) for k, j in enumerate(np.lexsort((np.arange(len(d)), d))[:5])]
        got = sorted((a["qid"], a["id"]) for a in run(in_range(4.0, distance=DistanceType.DTW, band=3)).collect())
        assert got == [(i, int(j)) for i, d in enumerate(want) for j in np.flatnonzero(d <= 4.0)]
