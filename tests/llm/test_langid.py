import base64
import random
import string
import zlib

import numpy as np

from tessera.llm import langid
from tests.llm.cases import SCHEMA, awkward, frame


def test_separates_languages_and_rejects(spark):
    r = random.Random(4)
    vocab = {"aa": ["the", "and", "thing", "with"], "bb": ["der", "und", "schön", "nicht"], "cc": ["les", "été", "avec", "pour"]}
    rows = []
    for i in range(300):
        lang = r.choice(sorted(vocab))
        rows.append((i, " ".join(r.choice(vocab[lang]) for _ in range(30)), lang, None, 0, "", "", 0, ""))
    rows += [(900, None, "aa", None, 0, "", "", 0, ""), (901, "123 ... !!", None, None, 0, "", "", 0, ""), (902, "", "aa", None, 0, "", "", 0, ""), (903, "ß", None, None, 0, "", "", 0, "")]
    out = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    for i, _, lang, *_ in rows[:300]:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert out[i].lang_pred == lang and not out[i].rejected and 0 <= out[i].score <= 1.0
    for i in (900, 901, 902):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out[903].lang_pred in vocab


def test_awkward_and_empty(spark):
    assert langid.identify(frame(spark, [])).count() == 0
    rows = awkward()
    assert langid.identify(frame(spark, rows)).count() == len(rows)
    assert {r.lang_pred for r in langid.identify(frame(spark, rows).drop("lang").selectExpr("*", "string(null) lang")).collect()} == {"und"}


def prose(r, vocab, n):
    return " ".join(r.choice(vocab) for _ in range(n))


def test_keeps_clean_texts_of_any_length_and_rejects_others(spark):
    r = random.Random(8)
    vocab = {"aa": "the and of to in is that it was for with his they have this from not are but had".split(), "bb": "der die und das ist nicht ein eine mit auf für sich dem auch als nach wie über bei schön".split()}
    clean = [(i, prose(r, vocab[("aa", "bb")[i % 2]], r.choice([1, 2, 3, 5, 8, 20, 60, 200, 800])), ("aa", "bb")[i % 2]) for i in range(600)]
    odd = {
        "letters": "".join(r.choice(string.ascii_letters) for _ in range(2000)), "words": " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(2, 9))) for _ in range(300)),
        "base64": base64.b64encode(r.randbytes(1500)).decode(), "hex": r.randbytes(1000).hex(), "code": "if (x[i] >= kMax && !ok()) { return f(x, y); }\n" * 40,
        "other": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan " * 20, "letterless": "12 34 ... !!",
    }
    rows = [(i, t, lang, None, 0, "", "", 0, "") for i, t, lang in clean] + [(1000 + i, t, None, None, 0, "", "", 0, "") for i, t in enumerate(odd.values())]
    out = {x.doc_id: x.rejected for x in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(out[i] for i, _, _ in clean) <= 3
    assert all(out[1000 + i] for i in range(len(odd)))


def test_scores_against_plain_python(spark):
    r = random.Random(9)
    rows = [(i, prose(r, [f"{p}{s}" for p in ("wa", "ko", "rin", "é") for s in ("n", "to", "mu")], 12) + (" 12!! x" if i % 3 else ""), ("aa", "bb")[i % 2], None, 0, "", "", 0, "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df)

    def score(text):
        folded, last = [], None
        for x in text.encode():
            y = x if x >= 128 or 97 <= (x | 32) <= 122 and 65 <= x <= 122 and chr(x).isalpha() else 32
            y = y + 32 if 65 <= y <= 90 else y
            if not (y == 32 and last == 32):
                folded.append(y)
            last = y
        v = np.zeros(langid.DIM)
        for k in (1, 2, 3):
            for i in range(len(folded) - k + 1):
                code = 0
                for y in folded[i : i + k]:
                    code = code << 8 | y
                v[(code + ((k - 1) << 24)) * 2654435761 % 2**32 >> 20] += 1
        v = np.log1p(v) * model.idf
        return (model.centroids @ (v / np.linalg.norm(v))).max()

    for x in langid.predict(df, model, {"doc_id": "d", "text": "t"}).collect():
        assert abs(x.score - score(x.t)) < 1e-5
