import hashlib

import pytest

from tessera.llm import dedup
from tests.llm.cases import awkward, frame


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("block,chunk", [(256, 32 << 20), (1024, 2000)])
def test_against_brute_force(spark, block, chunk):
    rows = awkward()
    got = dedup.exact_duplicates(frame(spark, rows), block=block, chunk=chunk).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(lower(t), []).append(d)
    by_sha = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.doc_id in ids
        assert r.group_size == len(ids)
        assert r.keep_id == max((x for x in ids if x is not None), default=None)
        if r.kept:
            kept[r.text_sha256] = kept.get(r.text_sha256, 0) + 1
            assert r.doc_id == r.keep_id
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}


def test_empty_table(spark):
    assert dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_drop_keeps_one_of_each_and_all_columns(spark):
    rows = awkward()
    df = frame(spark, rows)
    out = dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns
    texts = [lower(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({lower(t) for _, t, _ in rows})
