import numpy as np
import pytest

from tessera.operators import search
from tessera.sources import files, memory

R = np.random.default_rng(9)


def matrix(df):
    return np.array([r.series for r in sorted(df.collect(), key=lambda r: r.id)])


def test_raw_floats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RANGE_BYTES", 4 * 12 * 7)
    x = R.normal(size=(100, 12)).astype("<f4")
    path = tmp_path / "x.bin"
    path.write_bytes(x.tobytes() + b"abc")
    assert np.array_equal(matrix(files.read_raw(spark, str(path), 12)), x)
    assert np.array_equal(matrix(files.read_raw(spark, str(path), 12, n=33)), x[:33])
    with pytest.raises(ValueError):
        files.read_raw(spark, str(path), 12, n=101)
    got = sorted(files.read_binary(spark, str(path), 12).collect(), key=lambda r: r.place)
    assert np.array_equal([r.series for r in got], x)


@pytest.mark.parametrize("kind", ["f", "i"])
def test_vecs(spark, tmp_path, kind):
    x = R.integers(-9, 9, size=(50, 7)).astype("<f4" if kind == "f" else "<i4")
    path = tmp_path / "x.vecs"
    path.write_bytes(b"".join(np.int32(7).astype("<i4").tobytes() + r.tobytes() for r in x))
    read = files.read_fvecs if kind == "f" else files.read_ivecs
    assert np.array_equal(matrix(read(spark, str(path))), x)
    assert np.array_equal(matrix(read(spark, str(path), 11)), x[:11])
    path.write_bytes(path.read_bytes() + b"x")
    with pytest.raises(Exception, match="whole number"):
        read(spark, str(path)).collect()


def test_generators_and_samples(spark):
    a, b = (matrix(memory.random_series(spark, 30, 16, seed=s)) for s in (1, 1))
    assert np.array_equal(a, b) and not np.array_equal(a, matrix(memory.random_series(spark, 30, 16, seed=2)))
    assert np.allclose(a.mean(axis=1), 0, atol=1e-5) and np.allclose(a.std(axis=1), 1, atol=1e-5)
    df = memory.from_numpy(spark, R.normal(size=(60, 4)))
    ids = [r.id for r in memory.sample(df, 20).collect()]
    assert len(set(ids)) == 20 and ids == [r.id for r in memory.sample(df, 20).collect()]
    assert memory.sample(df, 100).count() == 60
    with pytest.raises(ValueError):
        memory.from_numpy(spark, np.zeros(3))


def test_registry():
    r = memory.Registry()
    r.add("Demo", memory.Dataset("base.fvecs", {"test": "q.fvecs"}, "truth.ivecs"))
    assert r.paths("demo") == ("base.fvecs", "q.fvecs", "truth.ivecs")
    with pytest.raises(KeyError):
        r.paths("demo", "noisy")
    with pytest.raises(KeyError):
        r.paths("other")


def test_writers(spark, tmp_path):
    x = R.normal(size=(30, 8)).astype(np.float32)
    df = memory.from_numpy(spark, x)
    found = search.top_k(df, x[:5], 3)
    files.write_top_k_text(found, str(tmp_path / "t"))
    lines = [ln for p in sorted((tmp_path / "t/indices").glob("part-*")) for ln in p.read_text().splitlines()]
    assert [int(ln.split()[0]) for ln in lines] == [0, 1, 2, 3, 4]
    files.write_range(search.range_search(df, x[:5], 8.0), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).columns == ["qid", "id", "dist"]
    files.write_series(df, str(tmp_path / "s"))
    assert np.array_equal(matrix(spark.read.parquet(str(tmp_path / "s"))), x)
