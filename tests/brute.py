"""Searches by their definition, one pair at a time."""

import numpy as np


def l2(a, b):
    return float(((np.asarray(a, float) - np.asarray(b, float)) ** 2).sum())


def dtw(a, b, band):
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(n, i + band) + 1):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return float(d[n, n])


def pairs(q, x, metric=l2):
    return {i: sorted((metric(v, s), j) for j, s in enumerate(x)) for i, v in enumerate(q)}


def check_top_k(rows, q, x, k, metric=l2):
    want = pairs(q, x, metric)
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["dist"]))
    assert set(got) == set(want)
    for i, near in want.items():
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, k + 1))
        assert np.allclose([m[2] for m in mine], [d for d, _ in near[:k]], rtol=1e-9, atol=1e-9)
        assert len({m[1] for m in mine}) == k
        for _, j, d in mine:
            assert np.isclose(metric(q[i], x[j]), d, rtol=1e-9, atol=1e-9)
        if len({round(d, 9) for d, _ in near}) == len(near):
            assert [m[1] for m in mine] == [j for _, j in near[:k]]


def check_range(rows, q, x, r, metric=l2):
    got = sorted((a["qid"], a["id"]) for a in rows)
    assert got == sorted((i, j) for i, near in pairs(q, x, metric).items() for d, j in near if d <= r)
