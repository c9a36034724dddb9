"""BPE encoding and decoding: a segment tree over adjacent pair ranks.

A word's symbols lie in the leaves' order; leaf i holds the rank of the pair that symbol i forms with the next live
symbol (and i itself, so that of equal ranks the leftmost wins). The root is the next merge. A merge changes three
leaves, and each change costs one walk to the root; it ends when the root holds no pair. Words of up to ``WIDE`` bytes
are merged together, one tree a row of a matrix; longer ones one by one with the same tree.

Texts are split at the regular expression of the byte-level pre-tokenizer. Each distinct stretch between two spaces is
encoded once per cache epoch; the cache holds at most ``CACHE`` stretches.

Null and empty texts have no tokens. Nothing else is special: a text of any length is encoded whole, repeated rows
give repeated results, and columns besides ``id_col`` and ``text_col`` are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import release
from tessera.llm._text import pieces

#: Unicode white space (unlike ``str.isspace`` without U+001C to U+001F).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A space or line feed beside other white space, or at the end of the text, is no safe place to cut.
_KNOTTY = re.compile(rf"[ \n](?:[{_WS}]|\Z)|[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \n]")
WIDE = 64
CACHE = 150_000
_NONE = np.int64(2**62)


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        for token, i in self.added.items():
            spelled[i] = token.encode()
        self.lengths = np.array([len(b) for b in spelled], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.lengths)))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.made = keys, first.astype(np.int64), made[first]
        self.added_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}  # a stretch that follows a space, or begins with a line feed
        self.bare: dict[str, int] = {}  # any other
        self.tokens: dict[str, int] = {}  # words as the regular expression splits them
        self.token_ids, self.token_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)  # ends[0] stays 0
        self.n = 0

    # merging

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, or -1."""
        key = left << 20 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (right >= 0), i, -1)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        i = self._pairs(left, right)
        return np.where(i >= 0, self.ranks[i] * width + at, _NONE)

    def _merge_many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``width`` bytes: a matrix with -1 where no symbol is left."""
        n, column = len(starts), np.arange(width)
        inside = column < lengths[:, None]
        symbols = np.where(inside, self.byte_ids[data[np.where(inside, starts[:, None] + column, 0)]], -1)
        after = np.where(column + 1 < lengths[:, None], column + 1, width)
        before = np.broadcast_to(column - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE)
        right = np.concatenate((symbols[:, 1:], np.full((n, 1), -1)), axis=1)
        tree[:, width:] = self._leaf(symbols, right, column, width)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while rows.size:
            at = tree[rows, 1] % width
            gone = after[rows, at]
            symbols[rows, at] = self.made[self._pairs(symbols[rows, at], symbols[rows, gone])]
            symbols[rows, gone] = -1
            then = after[rows, gone]
            after[rows, at] = then
            inner = then < width
            before[rows[inner], then[inner]] = at[inner]
            follows = np.where(inner, symbols[rows, np.where(inner, then, 0)], -1)
            tree[rows, width + gone] = _NONE
            tree[rows, width + at] = self._leaf(symbols[rows, at], follows, at, width)
            prior = before[rows, at]
            r, p = rows[prior >= 0], prior[prior >= 0]
            tree[r, width + p] = self._leaf(symbols[r, p], symbols[r, after[r, p]], p, width)
            for r, leaf in ((rows, gone), (rows, at), (r, p)):
                node = (width + leaf) >> 1
                while node.size and node[0]:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < _NONE]
        return symbols, inside

    def _merge_one(self, word: bytes) -> list[int]:
        """The same tree for one word of any length."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)]
        leaves = np.full(width, _NONE)
        leaves[: n - 1] = self._leaf(symbols[:-1], symbols[1:], np.arange(n - 1), width)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [int(_NONE), *(int(x) for level in reversed(levels) for x in level)]
        symbols = [int(x) for x in symbols]
        after, before, none = [*range(1, n + 1)], [*range(-1, n - 1)], int(_NONE)
        seen: dict[tuple[int, int], tuple[int, int]] = {}

        def pair(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in seen:
                i = int(self._pairs(np.array([a]), np.array([b]))[0])
                seen[a, b] = (int(self.ranks[i]), int(self.made[i])) if i >= 0 else (-1, -1)
            return seen[a, b]

        def put(leaf: int) -> None:
            nxt = after[leaf]
            rank = pair(symbols[leaf], symbols[nxt])[0] if nxt < n else -1
            node = width + leaf
            tree[node] = rank * width + leaf if rank >= 0 else none
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while tree[1] < none:
            at = tree[1] % width
            gone = after[at]
            symbols[at] = pair(symbols[at], symbols[gone])[1]
            symbols[gone] = -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            after[gone] = n
            put(gone)
            put(at)
            if before[at] >= 0:
                put(before[at])
        return [x for x in symbols if x >= 0]

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number for each word."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        data, starts = np.frombuffer(b"".join(tokens) or b"\0", np.uint8), np.concatenate(([0], np.cumsum(lengths)))[:-1]
        ids: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        low = 0
        for width in (8, 16, 32, WIDE):
            for rows in (lambda x: np.array_split(x, max(1, len(x) * width >> 20)))(np.flatnonzero((lengths > low) & (lengths <= width))):
                if rows.size:
                    symbols, _ = self._merge_many(data, starts[rows], lengths[rows], width)
                    r, c = np.nonzero(symbols >= 0)
                    ids.append(symbols[r, c])
                    owner.append(rows[r])
            low = width
        for i in np.flatnonzero(lengths > WIDE):
            ids.append(np.array(self._merge_one(tokens[i]), np.int64))
            owner.append(np.full(len(ids[-1]), i))
        if not ids:
            return np.zeros(0, np.int64), np.zeros(len(tokens), np.int64)
        flat, own = np.concatenate(ids), np.concatenate(owner)
        return flat[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(tokens))

    # texts

    def _learn(self, fresh: list[tuple[dict[str, int], str, str]]) -> None:
        """Encodes stretches: (table, key, text)."""
        split = [_SPLIT.findall(text) for _, _, text in fresh]
        unseen = [t for t in dict.fromkeys(t for s in split for t in s) if t not in self.tokens]
        if unseen:
            ids, counts = self.merge([t.encode() for t in unseen])
            self.tokens.update(zip(unseen, range(len(self.tokens), len(self.tokens) + len(unseen)), strict=True))
            self.token_ids = np.concatenate((self.token_ids, ids))
            self.token_ends = np.concatenate((self.token_ends, self.token_ends[-1] + np.cumsum(counts)))
        tokens = np.array([self.tokens[t] for s in split for t in s], np.int64)
        sizes = self.token_ends[tokens + 1] - self.token_ends[tokens]
        took = self.token_ids[np.repeat(self.token_ends[tokens] - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())]
        each = np.array([len(s) for s in split])
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(each)]
        base = int(self.ends[self.n])
        while base + len(took) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(fresh) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[base : base + len(took)] = took
        self.ends[self.n + 1 : self.n + 1 + len(fresh)] = base + ends
        for i, (table, key, _) in enumerate(fresh):
            table[key] = self.n + i
        self.n += len(fresh)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number for each text."""
        if self.n > CACHE:
            self.clear()
        parts: list[tuple[list[str], list[str]]] = []  # stretches that follow a space; others
        shape: list[tuple[int, bool]] = []  # text, whether its first stretch is bare
        fixed: dict[int, int] = {}
        for i, text in enumerate(texts):
            for j, part in enumerate(self.added_split.split(text) if self.added_split and any(t in text for t in self.added) else [text]):
                if part in self.added and j % 2:
                    fixed[len(parts)] = self.added[part]
                    parts.append(([], []))
                elif not part:
                    continue
                elif _KNOTTY.search(part):
                    parts.append(([], _SPLIT.findall(part)))
                else:
                    spaced = part.replace("\n", " \n").split(" ")
                    first = spaced.pop(0)
                    parts.append((spaced, [first] if first else []))
                shape.append((i, False))
        want = set().union(*(p[0] for p in parts)) if parts else set()
        bare = set().union(*(p[1] for p in parts)) if parts else set()
        fresh = [(self.index, s, s if s[0] == "\n" else " " + s) for s in want if s not in self.index] + [(self.bare, s, s) for s in bare if s not in self.bare]
        if fresh:
            self._learn(fresh)
        units: list[int] = []
        owner_counts = np.zeros(len(texts), np.int64)
        for k, ((spaced, first), (i, _)) in enumerate(zip(parts, shape, strict=True)):
            n = len(units)
            if k in fixed:
                units.append(-1 - fixed[k])
            units.extend(map(self.bare.__getitem__, first))
            units.extend(map(self.index.__getitem__, spaced))
            owner_counts[i] += len(units) - n
        unit = np.array(units, np.int64)
        special = unit < 0
        begin = np.where(special, 0, self.ends[np.where(special, 0, unit)])
        sizes = np.where(special, 1, self.ends[np.where(special, 0, unit) + 1] - begin)
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        ids[total[:-1][special]] = -1 - unit[special]
        return ids.astype(np.uint32), np.diff(total[np.concatenate(([0], np.cumsum(owner_counts)))])

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids spell."""
        sizes = self.lengths[ids]
        total = np.concatenate(([0], np.cumsum(sizes)))
        return self.spelled[np.repeat(self.at[ids] - total[:-1], sizes) + np.arange(total[-1])]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def texts_of(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of runs of whole texts of about ``most`` bytes; null is empty."""
    from tessera.llm._text import as_buffer

    data, offsets = as_buffer(column)
    for a, b, _, _ in pieces(data, offsets, most):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text; a null or empty text has an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for a, b, texts in texts_of(batch.column(1)):
                ids, counts = bpe.encode(texts)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["id", "ids"])
            release()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for rows of token ids; a null array gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids as little-endian uint32 and of the decoded text.

    Encodes and decodes in one pass over the texts, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for a, b, texts in texts_of(batch.column(1)):
                ids, counts = bpe.encode(texts)
                at = np.concatenate(([0], np.cumsum(counts)))
                spelled = bpe.decode_bytes(ids)
                cut = np.concatenate(([0], np.cumsum(bpe.lengths[ids])))[at]
                raw, text = ids.astype("<u4").tobytes(), spelled.tobytes()
                one = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
                two = [hashlib.sha256(text[x:y].decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(one), pa.array(two)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            release()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
