"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, token int, chunk string"


def frame(spark, rows):
    """rows of (doc_id, text, source); the other columns are there to clash with names used inside."""
    return spark.createDataFrame([(d, t, None if d is None else ("aa" if d % 2 else "bb"), s, 0, "x", "y", 1, "z") for d, t, s in rows], SCHEMA)


def awkward(seed: int = 1, n: int = 60):
    r = random.Random(seed)
    word = ["alpha", "beta", "Gamma", "delta", "épsilon", "the", "of", "日本", "x,", "eta"]
    base = [" ".join(r.choice(word) for _ in range(r.randint(1, 80))) for _ in range(n)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(1000 + i, base[i % 7], "s0") for i in range(20)]  # copies
    for i in range(20):  # near copies
        w = base[i + 10].split(" ")
        w[r.randrange(len(w))] = "changed"
        rows.append((2000 + i, " ".join(w), "s1"))
    passage = " ".join(r.choice(word) + str(j) for j in range(40))
    rows += [(3000 + i, f"{base[i]}\n{passage}  {base[i + 1]}", "s2") for i in range(8)]
    rows += [(4000, None, None), (4001, "", "s0"), (4002, " \t\n", None), (4003, base[3].upper(), "s1"), (4004, "one", "s9"), (4005, "long " * 20000 + "end", "s2"), (4006, "w" * 50000, "s1")]
    rows += [(5, base[5], "s2"), (5, base[5], "s2"), (7, "another text with the id seven", "s1"), (None, base[2], "s0"), (None, "no id at all", "s0")]
    return rows
