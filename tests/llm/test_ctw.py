import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ctw
from tests.llm.cases import awkward, frame


def lower(t):
    return (t or "").encode().lower()


class Tree:
    """Context-tree weighting by its definition, one node at a time."""

    def __init__(self, depth):
        self.depth, self.n = depth, {}

    def steps(self, text):
        data = b"\xff" * self.depth + text + b"\xff"
        for i in range(self.depth, len(data)):
            context, node = data[i - self.depth : i][::-1], 1
            for j in range(7, -1, -1):
                bit = data[i] >> j & 1
                yield context, node, bit
                node = node << 1 | bit

    def learn(self, text):
        for context, node, bit in self.steps(text):
            for d in range(self.depth + 1):
                self.n.setdefault((context[:d], node), [0, 0])[bit] += 1

    def finish(self):
        children = {}
        for c, q in self.n:
            if c:
                children.setdefault((c[:-1], q), []).append((c, q))
        kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        self.own = {}
        weighted = {}
        for key in sorted(self.n, key=lambda k: -len(k[0])):
            e = kt(*self.n[key])
            if len(key[0]) == self.depth:
                weighted[key] = e
            else:
                below = sum(weighted[c] for c in children.get(key, ()))
                weighted[key] = float(np.logaddexp(math.log(0.5) + e, math.log(0.5) + below))
                self.own[key] = math.exp(math.log(0.5) + e - weighted[key])

    def score(self, text):
        total = 0.0
        for context, node, bit in self.steps(text):
            p = None
            for d in range(self.depth, -1, -1):
                n = self.n.get((context[:d], node), [0, 0])
                e = (n[bit] + 0.5) / (sum(n) + 1)
                own = self.own.get((context[:d], node), 0.5)
                p = e if p is None else own * e + (1 - own) * p
            total += math.log10(p)
        return total


def test_against_the_definition(spark):
    rows = awkward() + [(4007, "a\0b\0", None), (4008, "a", None)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    tree, words = Tree(3), {}
    total = ends = 0
    for d, t, _ in rows:
        if not held(d):
            tree.learn(lower(t))
            w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t))
            for x in w:
                words[x] = words.get(x, 0) + 1
            total += len(w) + 1
            ends += 1
    tree.finish()
    got = ctw.score_documents(frame(spark, rows), F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0, depth=3).collect()
    assert len(got) == len(rows)
    scale = total + 0.1 * (len(words) + 2)
    want = []
    for d, t, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", lower(t))
        base = sum(math.log10((words.get(x, 0) + 0.1) / scale) for x in w) + math.log10((ends + 0.1) / scale)
        want.append((d, held(d), len(w) + 1, sum(x in words for x in w) + 1, total, base, tree.score(lower(t))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


def test_decisions_sum_to_one():
    r = np.random.default_rng(1)
    codes = np.array([c << 24 | b << 16 | 97 << 8 | x for c, b in ((97, 98), (98, 97)) for x in range(256)], np.uint64)
    p2, node, z, o, w = ctw.subtrees(codes, r.integers(0, 50, len(codes)).astype(float), 3)
    rows = []
    for c in (97, 98):
        for q in range(1, 256):
            m = (node >> 16 == c) & (node & 255 == q)
            rows.append({"c": c, "q": q, "zeros": z[m].sum(), "ones": o[m].sum(), "below": w[m].sum()})
    p = 10 ** ctw.gram_logs(codes, p2, ctw.top_of_tree(rows), 3)
    assert np.allclose(p.reshape(2, 256).sum(axis=1), 1)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 10.0, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_empty(spark):
    assert ctw.score_documents(frame(spark, []), F.lit(False)).count() == 0
    got = ctw.score_documents(frame(spark, [(1, None, None), (2, "ab", None)]), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert math.isclose(next(r.score for r in got if r.doc_id == 2), 24 * math.log10(0.5), rel_tol=1e-6)


def test_ids_that_are_texts(spark):
    df = spark.createDataFrame([("a", "some text"), ("b", "some other text"), (None, "some text")], "doc_id string, text string")
    got = ctw.score_documents(df, F.col("id") == "b").collect()
    assert sorted((r.doc_id or "", r.held_out) for r in got) == [("", False), ("a", False), ("b", True)]


def test_deep_contexts(spark):
    rows = [(i, f"{a} likes {b} and {a[::-1]} too; \u00e9\u4e2d", None) for i, (a, b) in enumerate((a, b) for a in ("anna", "bertha", "carl") for b in ("plums", "pears", "prunes", ""))]
    held = lambda d: d % 4 == 1
    for depth in (5, 7):
        tree = Tree(depth)
        for d, t, _ in rows:
            if not held(d):
                tree.learn(lower(t))
        tree.finish()
        got = {r.doc_id: r.score for r in ctw.score_documents(frame(spark, rows), F.col("id") % 4 == 1, depth=depth).collect()}
        for d, t, _ in rows:
            assert math.isclose(got[d], tree.score(lower(t)), rel_tol=1e-9)


def test_keys_hold_whole_grams():
    r = np.random.default_rng(2)
    for depth in range(2, ctw.MOST + 1):
        codes = r.integers(0, 2 ** min(63, 8 * depth + 8), 5000, dtype=np.uint64)
        assert (ctw.gather(ctw.spread(codes, depth), depth) == codes).all()


def test_what_is_gathered_grows_with_the_corpus():
    r = np.random.default_rng(3)
    names = ["".join(r.choice(list("aeioulmnrst"), r.integers(3, 9))) for _ in range(3000)]
    sizes = []
    for n in (2_000, 20_000):
        data = np.frombuffer(" ".join(r.choice(names, n)).encode(), np.uint8)
        sizes.append(len(np.unique(ctw.grams(data, np.array([0, len(data)]), ctw.DEPTH)[0])))
    assert sizes[1] > 3 * sizes[0]
