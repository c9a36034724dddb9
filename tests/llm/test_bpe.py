import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tests.llm.cases import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    r = random.Random(3)
    some = ["", " ", "  ", "a  b", " a", "a ", "foo\n bar", "foo \nbar", "foo\n \nbar", "foo\n ", "\n\n  x  \n", "it's we'll  DON'T 'sx", "x<|endoftext|>y <|endoftext|>", "é" * 500 + " " + "a" * 3000, "\x1c\x1d a\x85b\xa0c\u3000d", "0123456789" * 50, "\u200b\u200bz", "🙂🙂 👍🏽 a\r\nb"]
    return some + ["".join(r.choice("ab \n\t'sé1.,😀\xa0") for _ in range(r.randint(1, 40))) for _ in range(500)]


def test_matches_the_library(library):
    texts = odd_texts()
    e = bpe.Encoder(PATH)
    ids, counts = e.encode(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert list(own) == library.encode(t, add_special_tokens=False).ids
        assert e.decode(own) == library.decode(list(own), skip_special_tokens=False)


def test_cache_reset_changes_nothing(monkeypatch):
    texts = odd_texts()
    e = bpe.Encoder(PATH)
    want = e.encode(texts)[0]
    monkeypatch.setattr(bpe, "CACHE", 10)
    parts = [e.encode([t])[0] for t in texts]
    assert list(np.concatenate(parts)) == list(want)


def test_operator(spark, library):
    rows = awkward()
    got = bpe.round_trip(frame(spark, rows), PATH).collect()
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(frame(spark, []), PATH).count() == 0


def test_encode_then_decode(spark):
    rows = [r for r in awkward() if r[1] is not None]
    back = bpe.decode_documents(bpe.encode_documents(frame(spark, rows), PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((d, t) for d, t, _ in rows), key=repr)
