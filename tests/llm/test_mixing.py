import math
import re

from tessera.llm import mixing
from tests.llm.cases import awkward, frame


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(w[s] for s in names if s not in full)
        left = total - sum(most * sizes[s] for s in full)
        t = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if t[s] > most * sizes[s]} | {s for s in names if sizes[s] == 0}
        if over <= full:
            return t
        full |= over


def test_targets_and_taken(spark):
    rows = awkward()
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = targets(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    again = mixing.mix_sources(frame(spark, rows)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_sizes(spark):
    rows = awkward()
    got = mixing.word_counts(frame(spark, rows), {"doc_id": "i"}).collect()
    assert sorted((r.i if r.i is not None else -1, r["size"]) for r in got) == sorted((d if d is not None else -1, size(t)) for d, t, _ in rows)


def test_empty_tables(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_sources(frame(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


def test_a_cut_text_has_its_own_length(spark):
    rows = [(i, "é " * (3 + i) + "end", "ab"[i % 2], "en", 0) for i in range(8)]
    df = spark.createDataFrame([(d, t, lang, s, len(t)) for d, t, s, lang, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.apply_mix(df).collect()
    assert any(r.text not in {t for _, t, *_ in rows} for r in got)
    assert all(r.n_chars == len(r.text) for r in got)
