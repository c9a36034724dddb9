import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import attribution
from tests.llm.cases import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(library, text, sections, rule):
    """sections: character spans; offsets of the library are characters."""
    n, crossing = [0] * len(sections), [0] * len(sections)
    where = [i for i, (a, b) in enumerate(sections) for _ in range(a, b)]
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        own = where[a:b]
        pick = own[0] if rule == "start" else own[-1] if rule == "end" else max(sorted(set(own)), key=own.count)
        n[pick] += 1
        crossing[pick] += len(set(own)) > 1
    return list(zip(n, crossing, [b - a for a, b in sections], strict=True))


def lines(text):
    out, at = [], 0
    for piece in text.split("\n"):
        out.append((at, min(len(text), at + len(piece) + 1)))
        at += len(piece) + 1
    return out[:-1] if text.endswith("\n") else out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_lines(spark, rule):
    library = Tokenizer.from_file(PATH)
    library.post_processor = None
    rows = [(i, t, None) for i, t in enumerate(["a\n\nb", "\n", "", None, "one two\n\n\n\nthree\n", "é\n日本語\n\n🙂x", "no line feed", "x\n" * 50])] + [r for r in awkward() if r[0] and r[0] > 900]
    got = {}
    for r in attribution.count_by_line(frame(spark, rows), PATH, rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.n_crossing, r.n_chars))
    for d, t, _ in rows:
        want = brute(library, t or "", lines(t or "") or [(0, 0)], rule)
        assert [x[1:] for x in sorted(got[d])] == want
    assert attribution.count_by_line(frame(spark, []), PATH, rule).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_fields(spark, rule):
    library = Tokenizer.from_file(PATH)
    library.post_processor = None
    rows = [(1, "hel", "lo wor", "ld"), (2, None, "x", ""), (3, "é", "é", "🙂"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, text string, c string")
    got = {}
    for r in attribution.count_by_field(df, PATH, ["a", "text", "c"], rule, id_col="id").collect():
        got.setdefault(r.id, []).append((r.section, r.n_tokens, r.n_crossing, r.n_chars))
    for i, *fields in rows:
        at, sections = 0, []
        for f in fields:
            sections.append((at, at + len(f or "")))
            at += len(f or "")
        assert [x[1:] for x in sorted(got[i])] == brute(library, "".join(f or "" for f in fields), sections, rule)
