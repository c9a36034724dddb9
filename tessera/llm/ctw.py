"""LM scoring by context-tree weighting over bytes, and an add-0.1 unigram baseline over words.

A byte is eight binary decisions; each of the 255 decision nodes has its own context tree over the ``depth`` bytes
before. A node holds how often its decision went either way in training; its Krichevsky-Trofimov estimate and the
product of its children's weighted probabilities are mixed half and half, from the deepest contexts up. With the counts
frozen this gives each decision a probability that mixes the estimates of all depths, and a text the sum of logarithms
(a byte that UTF-8 never uses stands for the end of a text, and for each byte before its start).

A probability depends on a byte and its context only, so the model is a table of distinct (depth + 1)-grams. Chunks of
documents send their distinct grams and words with training counts to buckets; a bucket of grams holds whole subtrees
below two bytes of context, and the top of the tree is a table of 256 * 255 nodes whatever the corpus. The buckets
answer each chunk with the probabilities of its own grams and the counts of its own words, and the chunk scores its
documents. What is gathered, grams of eight bytes and words, grows with the corpus; nothing but the tree's top is
collected or broadcast.

Null and empty texts have the end token only. A row whose held-out condition is null is learned from. Repeated
rows count as often as they occur. Without training documents all counts are 0 and each decision has probability 1/2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm._shared import Scratch
from tessera.llm._text import LOWER, as_buffer, pieces, word_hashes, words
from tessera.llm.chunks import bucket_edges, by_bucket, ordered, pack, pack_counts, plan_chunks, unpack, unpack_counts

DEPTH = 5
#: Stands for the end of a text and for each byte before its start; no UTF-8 text holds it.
END = 0xFF
#: The deepest context whose grams, with the byte itself, are 64-bit keys.
MOST = 7
#: Buckets of grams are 2^FINER times those of words; so many grams of a bucket are worked on at once.
FINER = 2
PART = 1 << 17
_PAIRS = np.random.Generator(np.random.PCG64(11)).permutation(1 << 16).astype(np.uint64)
_PAIRS_BACK = np.argsort(_PAIRS).astype(np.uint64)
_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0 (Stirling's series after eight shifts)."""
    down = np.zeros_like(x)
    for i in range(8):
        down += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - down


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov block probability of a zeros and b ones, as a natural logarithm."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


_LG_HALF, _LG_ONE = (log_gamma(np.arange(1 << 16) + x) for x in (0.5, 1.0))


def log_kt_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``log_kt`` of whole numbers, small ones from a table."""
    few = a + b < len(_LG_ONE)
    x, y = (np.where(few, v, 0).astype(np.int64) for v in (a, b))
    out = _LG_HALF[x] + _LG_HALF[y] - np.log(np.pi) - _LG_ONE[x + y]
    many = np.flatnonzero(~few)
    out[many] = log_kt(a[many], b[many])
    return out


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the context, nearest byte first, then the byte, in one integer; and the text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    padded = np.full(len(data) + n * (MOST + 1), END, np.uint8)
    padded[np.arange(len(data)) + owner.astype(np.int64) * (MOST + 1) + MOST] = LOWER[data]
    if not n:
        return np.zeros(0, np.uint64), owner
    # the eight bytes up to each one, the latest on top
    window = np.ndarray((len(padded) - MOST,), "<u8", padded, strides=(1,))
    use = np.ones(len(window), bool)
    begin = offsets[1:-1] + np.arange(1, n) * (MOST + 1)
    for i in range(MOST):
        use[begin - MOST + i] = False
    window = window[use]
    return window << np.uint64(8) >> np.uint64(8 * (8 - depth)) << np.uint64(8) | window >> np.uint64(56), np.repeat(np.arange(n, dtype=np.int32), sizes + 1)


def spread(codes: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit key, one for each gram, that keeps the grams of one subtree together and in order: the two nearest bytes
    permuted at random on top, the other bytes below."""
    low = np.uint64(8 * (depth - 1))
    return _PAIRS[(codes >> low).astype(np.int64)] << np.uint64(48) | (codes & (np.uint64(1) << low) - np.uint64(1)) << np.uint64(8 * (MOST - depth))


def gather(keys: np.ndarray, depth: int) -> np.ndarray:
    """The grams of ``spread`` keys."""
    low = np.uint64(8 * (depth - 1))
    return _PAIRS_BACK[(keys >> np.uint64(48)).astype(np.int64)] << low | (keys & np.uint64(2**48 - 1)) >> np.uint64(8 * (MOST - depth))


class Level:
    """The nodes of one depth for one of a byte's eight decisions: counts, weighted probability, each gram's node.

    ``codes``: distinct grams of this depth, those of one context adjacent and ascending by byte; ``n``: their counts.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, i: int):
        head = codes >> np.uint64(8 - i)  # context and the bits decided before
        new = np.ones(len(codes), bool)
        new[1:] = head[1:] != head[:-1]
        self.start, self.of = np.flatnonzero(new), np.cumsum(new) - 1
        self.bit = codes >> np.uint64(7 - i) & np.uint64(1) == 1
        both = np.add.reduceat(n, self.start) if len(codes) else np.zeros(0)
        self.ones = np.add.reduceat(np.where(self.bit, n, 0), self.start) if len(codes) else np.zeros(0)
        self.zeros = both - self.ones
        self.kt = log_kt_counts(self.zeros, self.ones)
        self.weighted = self.kt

    def mixed(self, below: np.ndarray) -> None:
        """``below``: for each node the sum of its children's weighted log probabilities."""
        self.weighted = np.logaddexp(_HALF + self.kt, _HALF + below)

    def own(self) -> np.ndarray:
        """The weight of the node's own estimate."""
        return np.exp(_HALF + self.kt - self.weighted)

    def predict(self) -> np.ndarray:
        """The node's own estimate of each gram's decision."""
        hits = np.where(self.bit, self.ones[self.of], self.zeros[self.of])
        return (hits + 0.5) / ((self.zeros + self.ones)[self.of] + 1.0)


def subtrees(codes: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities, at context depth 2, of the eight decisions of each gram; and (key, zeros, ones, weighted) of the
    depth-2 nodes, key being (nearest byte, byte before, decision).

    ``codes`` hold whole subtrees below two bytes of context, distinct, in an order that keeps equal contexts adjacent and
    bytes ascending.
    """
    # grams of each depth, from the deepest up, and where each gram's shorter form is among those of the depth above
    forms, counts, up = [codes], [n], []
    for _ in range(depth - 2):
        shorter, inverse = np.unique(forms[-1] >> np.uint64(16) << np.uint64(8) | forms[-1] & np.uint64(255), return_inverse=True)
        forms.append(shorter)
        counts.append(np.bincount(inverse, weights=counts[-1], minlength=len(shorter)))
        up.append(inverse)
    p = np.empty((len(codes), 8))
    nodes = []
    for i in range(8):
        levels = [Level(f, c, i) for f, c in zip(forms, counts, strict=True)]
        for child, level, inverse in zip(levels, levels[1:], up):
            level.mixed(np.bincount(level.of[inverse[child.start]], weights=child.weighted, minlength=len(level.start)))
        two = levels[-1]
        first = forms[-1][two.start].astype(np.int64)
        nodes.append(((first >> 8) << 8 | 1 << i | (first & 255) >> (8 - i), two.zeros, two.ones, two.weighted))
        # from depth 2 down: what the depths so far give a decision, and the weight that is left for deeper ones
        known, left = np.zeros(len(forms[-1])), np.ones(len(forms[-1]))
        for level, inverse in zip(levels[:0:-1], up[::-1], strict=True):
            own = level.own()[level.of]
            known = (known + left * own * level.predict())[inverse]
            left = (left * (1 - own))[inverse]
        p[:, i] = known + left * levels[0].predict()
    return p, *(np.concatenate([x[k] for x in nodes]) for k in range(4))


def top_of_tree(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From (nearest byte, decision, zeros, ones, sum of weighted) of all depth-2 nodes below: each node's own weight and its
    estimate of a one, at depths 1 and 0."""
    zeros, ones, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        zeros[r["c"], r["q"]], ones[r["c"], r["q"]], below[r["c"], r["q"]] = r["zeros"], r["ones"], r["below"]
    kt1 = log_kt(zeros, ones)
    weighted1 = np.logaddexp(_HALF + kt1, _HALF + below)
    z0, o0 = zeros.sum(axis=0), ones.sum(axis=0)
    kt0 = log_kt(z0, o0)
    weighted0 = np.logaddexp(_HALF + kt0, _HALF + weighted1.sum(axis=0))
    return np.exp(_HALF + kt1 - weighted1), (ones + 0.5) / (zeros + ones + 1), np.exp(_HALF + kt0 - weighted0), (o0 + 0.5) / (z0 + o0 + 1)


def gram_logs(codes: np.ndarray, p2: np.ndarray, top: tuple, depth: int) -> np.ndarray:
    """log10 of each gram's probability."""
    own1, one1, own0, one0 = top
    byte, near = (codes & np.uint64(255)).astype(np.int64), (codes >> np.uint64(8 * depth)).astype(np.int64)
    out = np.zeros(len(codes))
    for i in range(8):
        decision, bit = 1 << i | byte >> (8 - i), byte >> (7 - i) & 1 == 1
        e1, own = one1[near, decision], own1[near, decision]
        p = own * np.where(bit, e1, 1 - e1) + (1 - own) * p2[:, i]
        p = own0[decision] * np.where(bit, one0[decision], 1 - one0[decision]) + (1 - own0[decision]) * p
        out += np.log10(p)
    return out


def _lookup(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key over pieces of (sorted distinct keys, counts)."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, weights=weights, minlength=len(keys)).astype(np.int64)


def _squeeze(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, byte by byte from the top, so that the runs of their common heads compress."""
    return len(keys).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _expand(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    columns = np.frombuffer(pa.decompress(blob[8:], 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(columns.T).view(">u8").ravel().astype(np.uint64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.diff(first, append=len(keys))


def _count(bits: int, depth: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        data, offsets = as_buffer(table["text"])
        train = 1 - table["held"].to_numpy().astype(np.int64)
        word_parts, all_keys, all_held = [], [], []
        for a, b, d, o in pieces(data, offsets):
            low = LOWER[d]
            st, en, counts = words(low, o)
            word_parts.append(_distinct(word_hashes(low, st, en), np.repeat(train[a:b], counts)))
            codes, owner = grams(d, o, depth)
            keys, learned = spread(codes, depth), train[a:b][owner] == 1
            all_keys.append(keys[learned])
            all_held.append(keys[~learned])
        held = _runs(np.concatenate(all_held or [np.zeros(0, np.uint64)]))[0]
        gram_parts = [_runs(np.concatenate(all_keys or [np.zeros(0, np.uint64)])), (held, np.zeros(len(held), np.int64))]
        out: dict[str, list] = {c: [] for c in ("kind", "bucket", "chunk", "keys", "counts", "tokens")}
        for kind, parts in ((0, word_parts), (1, gram_parts)):
            keys, counts = _lookup(parts)
            split = bits + FINER if kind else bits
            edges = bucket_edges(keys, split)
            for b in range(1 << split):
                if edges[b] < edges[b + 1]:
                    part = slice(edges[b], edges[b + 1])
                    for c, v in zip(out, (kind, b, chunk, (_squeeze if kind else pack)(keys[part]), pack_counts(counts[part]), int(counts[part].sum())), strict=True):
                        out[c].append(v)
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary()), "tokens": pa.array(out["tokens"], pa.int64())})

    return run


def _parts(table: pa.Table, read=unpack) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(r["chunk"], read(r["keys"]), unpack_counts(r["counts"])) for r in table.sort_by("chunk").to_pylist()]


def _answer_words(table: pa.Table) -> pa.Table:
    """Each chunk's words' counts; in ``known`` of the first row, how many distinct words of the bucket are in training."""
    parts = _parts(table)
    keys, counts = _lookup([p[1:] for p in parts])
    known = [int((counts > 0).sum())] + [0] * (len(parts) - 1)
    return pa.table({"chunk": pa.array([p[0] for p in parts], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(parts), pa.int32()), "counts": pa.array([pack_counts(counts[np.searchsorted(keys, p[1])]) for p in parts], pa.binary()), "known": pa.array(known, pa.int64())})


def _subtree_runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Runs of about ``PART`` keys that hold whole subtrees below two bytes of context."""
    head = keys >> np.uint64(48)
    ends = np.append(np.flatnonzero(head[1:] != head[:-1]) + 1, len(keys))
    cuts = ends[np.unique(np.searchsorted(ends, np.append(np.arange(PART, len(keys), PART), len(keys))))]
    return list(zip([0, *cuts[:-1].tolist()], cuts.tolist()))


def _grow(depth: int):
    """The subtrees of a bucket: one row (c = -1) with its grams, and rows of sums for the top of the tree."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = _lookup([p[1:] for p in _parts(table, _expand)])
        p = np.empty((len(keys), 8))
        sums = []
        for a, b in _subtree_runs(keys):
            p[a:b], node, *values = subtrees(gather(keys[a:b], depth), n[a:b].astype(np.float64), depth)
            group, inverse = np.unique((node >> 16) << 8 | (node & 255), return_inverse=True)
            sums.append((group, *(np.bincount(inverse, weights=x, minlength=len(group)) for x in values)))
        group, z, o, w = (np.concatenate([x[k] for x in sums]) for k in range(4))
        m, bucket = len(group), table["bucket"][0].as_py()
        return pa.table(
            {
                "bucket": pa.array([bucket] * (m + 1), pa.int32()), "c": pa.array(np.append(group >> 8, -1), pa.int32()), "q": pa.array(np.append(group & 255, -1), pa.int32()),
                "zeros": pa.array(np.append(z, 0)), "ones": pa.array(np.append(o, 0)), "below": pa.array(np.append(w, 0)),
                "keys": pa.array([None] * m + [_squeeze(keys)], pa.binary()), "p": pa.array([None] * m + [p.tobytes()], pa.binary()),
            }
        )

    return run


def _answer_grams(depth: int, top):
    def run(sent: pa.Table, model: pa.Table) -> pa.Table:
        keys, p = _expand(model["keys"][0].as_py()), np.frombuffer(model["p"][0].as_py(), np.float64).reshape(-1, 8)
        logs = np.concatenate([gram_logs(gather(keys[a : a + PART], depth), p[a : a + PART], top.value, depth) for a in range(0, len(keys), PART)])
        rows = sent.sort_by("chunk").to_pylist()
        return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int32()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "logs": pa.array([logs[np.searchsorted(keys, _expand(r["keys"]))].tobytes() for r in rows], pa.binary())})

    return run


def _score(bits: int, depth: int, total: int, distinct: int, ends: int, id_type: pa.DataType):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        kinds = replies["kind"].to_numpy()
        counts = np.concatenate([unpack_counts(r["counts"]) for r in by_bucket(replies.filter(pa.array(kinds == 0)))] or [np.zeros(0, np.int64)])
        logs = np.concatenate([np.frombuffer(r["logs"]) for r in by_bucket(replies.filter(pa.array(kinds == 1)))] or [np.zeros(0)])
        data, offsets = as_buffer(table["text"])
        # the chunk's distinct words, as they were sent
        parts = list(pieces(data, offsets))
        found = [(words(LOWER[d], o), LOWER[d]) for _, _, d, o in parts]
        hashes = [word_hashes(low, st, en) for (st, en, _), low in found]
        word_keys = np.unique(np.concatenate(hashes))
        scale = total + 0.1 * (distinct + 1)
        end_log = np.log10((ends + 0.1) / scale)
        base, n_tokens, n_known = [], [], []
        for ((_, _, n), _), h in zip(found, hashes, strict=True):
            owner = np.repeat(np.arange(len(n)), n)
            c = counts[np.searchsorted(word_keys, h)]
            base.append(np.bincount(owner, weights=np.log10((c + 0.1) / scale), minlength=len(n)) + end_log)
            n_known.append(np.bincount(owner, weights=c > 0, minlength=len(n)) + (ends > 0))
            n_tokens.append(n + 1)
        # its grams: sorted once, each place gets the reply of its distinct gram
        coded = [grams(d, o, depth) for _, _, d, o in parts]
        keys, owner = np.concatenate([spread(c, depth) for c, _ in coded]), np.concatenate([w + np.int32(a) for (_, w), (a, _, _, _) in zip(coded, parts, strict=True)])
        by = np.argsort(keys)
        new = keys[by]
        new = np.concatenate((np.zeros(1, bool), new[1:] != new[:-1]))
        weights = np.empty(len(keys))
        weights[by] = logs[np.cumsum(new)]
        score = np.bincount(owner, weights=weights, minlength=table.num_rows)
        sizes = np.diff(offsets) + 1
        return pa.table(
            {
                "id": table["id"].cast(id_type), "held_out": table["held"], "n_tokens": pa.array(np.concatenate(n_tokens), pa.int64()), "n_known": pa.array(np.concatenate(n_known).astype(np.int64)),
                "train_tokens": pa.array(np.full(table.num_rows, total, np.int64)), "base_score": pa.array(np.concatenate(base)), "score": pa.array(score), "bits_per_byte": pa.array(-score / np.log10(2) / sizes),
            }
        )

    return run


def score_documents(df: DataFrame, held_out, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``held_out``: a condition on ``id``; the model learns from all other rows. Scores are log10 probabilities;
    bits_per_byte is the code length of the text and its end by byte.
    """
    spark, s = df.sparkSession, Scratch(df.sparkSession, "ctw")
    if not 2 <= depth <= MOST:
        raise ValueError(f"depth must be from 2 to {MOST}")
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("held", F.coalesce(held_out, F.lit(False)))
    kind = plain.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(plain.schema["id"].dataType)
    plan = plan_chunks(plain, grown=2)
    sent = s.write(plan.table.groupBy("chunk").applyInArrow(_count(plan.bits, depth), "kind int, bucket int, chunk int, keys binary, counts binary, tokens long"))
    word_rows, gram_rows = sent.where("kind = 0"), sent.where("kind = 1")
    word_replies = s.write(word_rows.groupBy("bucket").applyInArrow(_answer_words, "chunk int, bucket int, counts binary, known long"))
    ends = plain.where("not held").count()
    total = (word_rows.agg(F.sum("tokens")).first()[0] or 0) + ends
    distinct = (word_replies.agg(F.sum("known")).first()[0] or 0) + (ends > 0)

    model = s.write(gram_rows.groupBy("bucket").applyInArrow(_grow(depth), "bucket int, c int, q int, zeros double, ones double, below double, keys binary, p binary"))
    sums = model.where("c >= 0").groupBy("c", "q").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "below")))
    top = spark.sparkContext.broadcast(top_of_tree(sums.collect()))  # 256 * 255 rows at most
    gram_replies = gram_rows.select("bucket", "chunk", "keys").groupBy("bucket").cogroup(model.where("c < 0").select("bucket", "keys", "p").groupBy("bucket"))
    gram_replies = s.write(gram_replies.applyInArrow(_answer_grams(depth, top), "chunk int, bucket int, logs binary"))
    s.drop(sent, model)
    none = F.lit(None).cast("binary")
    replies = word_replies.select("chunk", "bucket", F.lit(0).alias("kind"), "counts", none.alias("logs")).unionByName(gram_replies.select("chunk", "bucket", F.lit(1).alias("kind"), none.alias("counts"), "logs"))
    kinds = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return plan.table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(plan.bits, depth, int(total), int(distinct), int(ends), id_type), kinds).withColumnRenamed("id", id_col)
