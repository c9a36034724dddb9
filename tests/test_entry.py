import duckdb
import pytest

import __spark_entry__
from tessera.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) == set(registry.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["qid", "rank", "id", "dist"] and rows.count() == 100


@pytest.mark.parametrize("name", ["l2_topk", "l2_range_native", "recent_topk", "znorm", "z_key", "envelope", "dft_features", "lb_sax_pairs", "user_series_topk", "rel_join", "rel_rollup"])
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()

    def plain(rows):
        return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)

    a, b = plain(tuple(r[n] for n in names) for r in got.collect()), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            assert v == w or abs(float(v) - float(w)) < 2e-5
