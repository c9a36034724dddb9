import duckdb
import numpy as np
import pytest

import __spark_entry__
from tessera.operators import search
from tessera.queries import searches, tables
from tests.brute import dtw
from tests.test_entry import SF, TABLES


@pytest.mark.parametrize("name", ["l2_topk", "l2_range_isax", "knn_label_vote", "lb_keogh_pairs", "lb_violations", "user_series_topk"])
def test_every_query_is_asked(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
    rows = sorted(tuple(r[n] for n in names) for r in got.collect())
    assert len(rows) == len(want)
    keys = [i for i, n in enumerate(names) if n not in ("dist", "bound")]
    order = lambda r: tuple(r[i] for i in keys)
    for a, b in zip(sorted(rows, key=order), sorted(want, key=order), strict=True):
        assert order(a) == order(b) and np.allclose(a, b, atol=2e-5)
    ids = [r[0] for r in db.execute("SELECT DISTINCT user_id FROM events WHERE user_id % 50 = 0" if name.startswith("user") else "SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0").fetchall()]
    if "qid" in names:
        assert {r[names.index("qid")] for r in rows} == set(ids) and (len(ids) > 1 or name.startswith("user"))


def test_warping_against_brute_force_on_sparse_ids(spark, tmp_path):
    r = np.random.default_rng(4)
    x = {25 * i: r.normal(size=16).astype(np.float32) / 2 for i in range(3, 33)}
    spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked = [i for i in x if i % 50 == 0]
    far = {q: sorted((dtw(x[q], v, searches.DTW_BAND), i) for i, v in x.items()) for q in asked}
    run = __spark_entry__.queries()
    for name in ("dtw_topk", "dtw_topk_isax"):
        got = sorted((a.qid, a["rank"], a.id) for a in run[name](spark, str(tmp_path)).collect())
        assert got == sorted((q, k + 1, far[q][k][1]) for q in asked for k in range(searches.DTW_K))
    got = sorted((a.qid, a.id) for a in run["dtw_range"](spark, str(tmp_path)).collect())
    assert got == sorted((q, i) for q in asked for d, i in far[q] if d <= searches.DTW_R)


def test_blocks_give_the_rows_of_one_batch(spark):
    s, q = tables.series(spark, SF), tables.queries(spark, SF)
    run = lambda b: search.search(s, b, searches.TOP)
    assert sorted(map(tuple, tables.in_blocks(q, run, 2000).collect())) == sorted(map(tuple, run(q).collect()))


@pytest.mark.parametrize("name", ["envelope", "symbol_regions"])
def test_every_row_is_transformed(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
    rows = sorted(map(tuple, got.collect()))
    assert np.allclose(np.array(rows, float), np.array(want, float), atol=2e-5)
    assert {r[0] for r in rows} == {r[0] for r in db.execute("SELECT vec_id FROM embeddings").fetchall()}


@pytest.mark.parametrize("name", ["lb_keogh_pairs", "lb_sax_pairs", "lb_violations", "user_series_topk"])
def test_pairs_are_made_by_blocks_not_by_a_join(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
