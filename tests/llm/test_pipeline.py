import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import awkward, frame
from tests.llm.test_dedup import lower
from tests.llm.test_jaccard import brute as near_brute
from tests.llm.test_mixing import size, targets


def test_each_stage_against_brute_force(spark, tmp_path):
    frame(spark, awkward()).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, columns = {}, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        kept[name] = after = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
            texts = {(r.doc_id, r.text) for r in before}
        if name == "language_id":
            assert {(r.doc_id, r.text) for r in after} <= texts
            assert all(r in after for r in [(x.doc_id, x.text, x.lang, x.source, x.n_chars, x.id, x.row, x.token, x.chunk) for x in before if x.text and 40 < len(x.text) < 1000])
            assert not [r for r in after if not (r.text or "").strip()]
        elif name == "exact_dedup":
            assert sorted(lower(r.text) for r in after) == sorted({lower(r.text) for r in before})
        elif name == "near_dedup":
            groups = near_brute([(i, r.text, None) for i, r in enumerate(before)], 5, 80)
            assert len(after) == len({c for _, _, c in groups})
            assert {(r.doc_id, r.text) for r in after} <= texts
        elif name == "mixing":
            sizes, taken = {}, {}
            for r in before:
                sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + size(r.text)
                assert any(d == r.doc_id and t.startswith(r.text) for d, t in texts)
            assert all(abs(taken.get(s, 0) - t) <= 0.5 + 1e-6 for s, t in targets(sizes).items())
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = []
            for r in before:
                ids = library.encode(r.text, add_special_tokens=False).ids
                want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
            assert sorted(map(tuple, after), key=repr) == sorted(want, key=repr)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, kept["bpe"]))


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_other_columns(spark, tmp_path):
    frame(spark, awkward()[:30]).select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
