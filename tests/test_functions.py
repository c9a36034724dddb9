import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import columns, kernels
from tests.brute import dtw, l2

R = np.random.default_rng(5)
X = np.cumsum(R.normal(size=(40, 32)), axis=1)


def test_symbols_count_cuts_strictly_below():
    cuts = np.array([-1.0, 0.0, 0.0, 2.0])
    assert list(kernels.symbolize(np.array([-2, -1, -0.5, 0, 0.1, 2, 3]), cuts)) == [0, 0, 1, 1, 3, 3, 4]
    assert list(kernels.quantize(np.array([[-2.0], [-1], [0], [2]]), cuts[None])[:, 0]) == [0, 1, 3, 4]


def test_breakpoints_nest():
    v = R.normal(size=1000)
    fine, coarse = kernels.equidepth_breakpoints(v, 16), kernels.equidepth_breakpoints(v, 4)
    assert np.allclose(fine[3::4], coarse)
    assert np.allclose(kernels.gaussian_breakpoints(256)[127], 0) and abs(kernels.gaussian_breakpoints(256)[-1] - 2.660067) < 1e-5


def test_normalization_guards_constant_rows():
    z = kernels.z_normalize(np.concatenate((X, np.ones((1, 32)))))
    assert np.allclose(z[:-1].mean(axis=1), 0) and np.allclose(z[:-1].std(axis=1), 1) and not z[-1].any()


@pytest.mark.parametrize("dim,segments", [(32, 8), (30, 7), (5, 5)])
def test_bounds_never_exceed_distances(dim, segments):
    x = X[:, :dim]
    lengths = np.diff(kernels.edges(dim, segments)).astype(float)
    cuts = kernels.equidepth_breakpoints(kernels.paa(x, segments).ravel(), 16)
    words = kernels.symbolize(kernels.paa(x, segments), cuts)
    f = kernels.fourier(x, min(dim, 9))
    bins = np.sort(f, axis=0)[(np.arange(1, 8) * len(f)) // 8].T
    sfa = kernels.quantize(f, bins)
    m, d = kernels.sketch(x, segments)
    for q in x[:6]:
        true = kernels.l2(q, x)
        p = kernels.paa(q[None], segments)[0]
        assert (kernels.table_bound(kernels.sax_table(p, p, cuts, lengths), words) <= true + 1e-9).all()
        weights = kernels.fourier_weights(dim, min(dim, 9))
        assert (kernels.table_bound(kernels.sfa_table(kernels.fourier(q[None], min(dim, 9))[0], bins, weights), sfa) <= true + 1e-9).all()
        (qm,), (qd,) = kernels.sketch(q[None], segments)
        assert (kernels.sketch_bound(qm, qd, m, d, lengths) <= true + 1e-9).all()
        for band in (1, 3):
            warped = kernels.dtw(q, x, band)
            up, lo = kernels.envelope(q[None], band)
            assert (kernels.lb_keogh(up[0], lo[0], x) <= warped + 1e-9).all() and (warped <= true + 1e-9).all()
            pu, pl = kernels.paa(up, segments)[0], kernels.paa(lo, segments)[0]
            assert (kernels.table_bound(kernels.sax_table(pu, pl, cuts, lengths), words) <= warped + 1e-9).all()


def test_whole_fourier_is_the_distance():
    for dim in (31, 32):
        x = X[:, :dim]
        n = 2 * (dim // 2 + 1)
        w, f = kernels.fourier_weights(dim, n), kernels.fourier(x, n)
        assert np.allclose((w * (f[0] - f[1]) ** 2).sum(), l2(x[0], x[1]))
        z = x - x.mean(axis=1, keepdims=True)
        w, f = kernels.fourier_weights(dim, n - 2, True), kernels.fourier(z, n - 2, True)
        assert np.allclose((w * (f[0] - f[1]) ** 2).sum(), l2(z[0], z[1]))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(0, 12), st.integers(0, 10**6))
def test_warping_by_its_definition(n, band, seed):
    r = np.random.default_rng(seed)
    q, x = r.normal(size=n), r.normal(size=(3, n))
    assert np.allclose(kernels.dtw(q, x, band), [dtw(q, v, band) for v in x])


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 8), st.integers(1, 9), st.integers(0, 10**6))
def test_z_keys_sort_like_interleaved_bits(bits, segments, seed):
    r = np.random.default_rng(seed)
    w = r.integers(0, 1 << bits, size=(20, segments)).astype(np.uint8)
    text = ["".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in row) for row in w.tolist()]
    keys = kernels.z_key(w, bits)
    assert sorted(range(20), key=lambda i: (keys[i], i)) == sorted(range(20), key=lambda i: (text[i], i))
    assert [int(t[:segments], 2) for t in text] == kernels.root_mask(w, bits).tolist()


def test_suffix_sums():
    assert list(kernels.suffix_sums(np.array([1.0, 2.0, 3.0]))) == [6, 5, 3]


def test_columns_equal_kernels(spark):
    x = X.astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(x)], "id long, s array<float>")
    x = x.astype(float)
    cuts = kernels.gaussian_breakpoints(16)
    s = F.col("s")
    p = columns.paa(s, 32, 7)
    up, lo = columns.envelope(s, 3)
    w = columns.symbolize(p, columns.array_of(cuts))
    q = columns.array_of(x[0])
    got = df.select(
        "id", columns.z_normalize(s).alias("z"), p.alias("p"), w.alias("w"), columns.root_mask(w, 4).alias("mask"), columns.z_key_hex(w, 7, 4).alias("key"), up.alias("up"), lo.alias("lo"),
        columns.fourier(s, 32, 6).alias("f"), columns.sketch(s, 32, 7).alias("k"), columns.l2(s, q).alias("l2"), columns.sax_bound(columns.array_of(kernels.paa(x[:1], 8)[0]), columns.symbolize(columns.paa(s, 32, 8), columns.array_of(cuts)), list(cuts), 4).alias("b"),
    ).orderBy("id").collect()
    words = kernels.symbolize(kernels.paa(x, 7), cuts)
    u, v = kernels.envelope(x, 3)
    m, d = kernels.sketch(x, 7)
    p8 = kernels.paa(x[:1], 8)[0]
    bound = kernels.table_bound(kernels.sax_table(p8, p8, cuts, np.full(8, 4.0)), kernels.symbolize(kernels.paa(x, 8), cuts))
    assert np.allclose([r.z for r in got], kernels.z_normalize(x)) and np.allclose([r.p for r in got], kernels.paa(x, 7))
    assert np.array_equal([r.w for r in got], words) and [r["mask"] for r in got] == kernels.root_mask(words, 4).tolist()
    assert [bytes.fromhex(r.key) for r in got] == kernels.z_key(words, 4)
    assert np.allclose([r.up for r in got], u) and np.allclose([r.lo for r in got], v)
    assert np.allclose([r.f for r in got], kernels.fourier(x, 6), atol=1e-6)
    assert np.allclose([[e["mean"] for e in r.k] for r in got], m) and np.allclose([[e.deviation for e in r.k] for r in got], d)
    assert np.allclose([r.l2 for r in got], kernels.l2(x[0], x)) and np.allclose([r.b for r in got], bound)
