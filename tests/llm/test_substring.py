import hashlib
import re

import pytest

from tessera.llm import substring
from tessera.llm._shared import Scratch
from tessera.llm.chunks import plan_ranges
from tests.llm.cases import awkward, frame


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, k):
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t, _ in rows:
        w = split(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, order(d)), order(d))
    out = []
    for d, t, _ in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < order(d):
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [3, 13])
def test_against_brute_force(spark, k):
    rows = awkward()
    got = substring.remove_repeats(frame(spark, rows), k=k)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k)


def test_spans_hold_the_same_words(spark):
    rows = [r for r in awkward() if r[0] not in (None, 5, 7)]
    texts = {d: split(t) for d, t, _ in rows}
    spans = substring.repeated_spans(frame(spark, rows)).collect()
    assert spans
    covered = {}
    for s in spans:
        assert s.src_id < s.doc_id and s.n_words >= 13
        assert texts[s.doc_id][s.start : s.start + s.n_words] == texts[s.src_id][s.src_start : s.src_start + s.n_words]
        covered.setdefault(s.doc_id, set()).update(range(s.start, s.start + s.n_words))
    for d, _, n, _ in brute(rows, 13):
        assert len(covered.get(d, ())) == n


def test_empty(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_chunks_follow_bytes(spark):
    """Twenty long texts with low ids, half of all ids null: no chunk has more than twice its share or one text."""
    rows = [(i, "w " * 20000) for i in range(20)] + [(i if i % 2 else None, f"a short text {i}") for i in range(100, 4000)] + [(-5, "below"), (10**12, "far above")]
    df = spark.createDataFrame(rows, "id long, text string")
    plan = plan_ranges(Scratch(spark, "t"), df, chunk=50_000)
    got = plan.table.collect()
    assert sorted(((r.id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    sizes, ids = {}, {}
    for r in got:
        sizes[r.chunk] = sizes.get(r.chunk, 0) + len(r.text) + 1
        if r.id is not None:
            ids.setdefault(r.chunk, []).append(r.id)
        assert (r.id is None) == (r.chunk >= plan.ranges)
    assert max(sizes.values()) <= 2 * max(50_000, 40_001)
    order = sorted(ids)
    assert all(max(ids[a]) < min(ids[b]) for a, b in zip(order, order[1:], strict=False))


def test_ids_that_are_no_numbers_raise(spark):
    df = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    with pytest.raises(TypeError, match="must be a number"):
        substring.remove_repeats(df)
