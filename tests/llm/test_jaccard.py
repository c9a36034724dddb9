import random
import re

import pytest

from tessera.llm import jaccard
from tessera.llm._shared import Scratch
from tessera.llm.components import components
from tests.llm.cases import awkward, frame


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t, _ in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows)), key=repr)


def chained(seed):
    """Groups of near copies of which many are far from each other and linked by a chain only."""
    r = random.Random(seed)
    rows, n = [], 0
    for g in range(6):
        w = [f"g{g}w{r.randrange(40)}" for _ in range(r.choice([12, 40, 120]))]
        for _ in range(r.choice([1, 5, 40])):
            rows.append((n, " ".join(w), None))
            n += 1
            for _ in range(r.choice([1, 1, 2])):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rows = awkward() + [(d + 9000, t, s) for d, t, s in chained(k)]
    got = jaccard.near_duplicates(frame(spark, rows), k=k, percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k, percent)


def test_large_groups_use_pivots(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 2)
    rows = chained(11) + [(d + 9000, t, s) for d, t, s in chained(12)]
    got = jaccard.near_duplicates(frame(spark, rows), k=3, percent=90)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 3, 90)


def test_keeps_one_of_each_component(spark):
    rows = awkward()
    df = frame(spark, rows)
    out = jaccard.near_duplicates(df, keep_all=True)
    assert out.columns == [*df.columns, "n_shingles", "component_id", "kept"]
    kept = [r for r in out.collect() if r.kept]
    assert len({r.component_id for r in kept if r.n_shingles}) == len({c for _, n, c in brute(rows, 5, 80) if n})
    assert sum(r.n_shingles == 0 for r in kept) == sum(n == 0 for _, n, _ in brute(rows, 5, 80))


def two_clusters(seed, g=30):
    """Sets that share tokens of the prefix without being linked: two clusters and single documents around one passage."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for c in range(3):
        own = [f"c{c}x{i}" for i in range(8)]
        for i in range(g if c < 2 else 1):
            w = passage + own
            if i:
                w[r.randrange(30, len(w))] = f"z{r.randrange(3)}"
            rows.append((100 * c + i, " ".join(w), None))
    return rows


@pytest.mark.parametrize("part", [3, 4096])
def test_unlinked_groups(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART", part)
    rows = two_clusters(1)
    for k, percent in ((1, 90), (1, 80), (2, 85)):
        got = jaccard.near_duplicates(frame(spark, rows), k=k, percent=percent)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k, percent)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_every_pair(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard, "PART", 3)
    rows = awkward() + [(d + 9000, t, s) for d, t, s in chained(5)] + [(d + 20000, t, s) for d, t, s in two_clusters(2, 8)]
    pairs, members = jaccard.similar_pairs(frame(spark, rows), k=k, percent=percent)
    members = members.collect()
    assert len(members) == len(rows)
    of = {}
    for d, c in members:
        of.setdefault(c, set()).add(d)
    sets = {}
    for d, t, _ in rows:
        if x := shingles(t, k):
            sets.setdefault(frozenset(x), set()).add(d)
    assert sum(d is None or not shingles(t, k) for d, t, _ in rows) >= len(of.pop(None, ()))
    by = {c: next(s for s, ids in sets.items() if ids == m) for c, m in of.items()}
    want = {frozenset((a, b)): len(a & b) for a in sets for b in sets if a != b and 100 * len(a & b) >= percent * len(a | b)}
    assert {frozenset((by[r.a], by[r.b])): r.shared for r in pairs.collect()} == want


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {x.node: x.comp for x in components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    comp = {}
    for u, v in edges:
        if u != v:
            a, b = comp.setdefault(u, {u}), comp.setdefault(v, {v})
            a |= b
            for x in a:
                comp[x] = a
    assert got == {x: min(c) for x, c in comp.items()}


def test_empty(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    assert jaccard.near_duplicates(frame(spark, [(1, None, None), (2, "", None)])).count() == 2
