"""Substring dedup by De Bruijn compaction.

Runs of ``k`` words are edges of a De Bruijn graph whose nodes are runs of k - 1. An edge repeats when it also starts
in a document with a smaller id. Each chunk of documents (ascending ids) sends the hashes of its distinct edges to hash
buckets, which answer with the first chunk that holds each. Consecutive repeated edges with one source chunk are a path;
equal paths of a chunk are one row with the places that have it, and equal paths of all chunks compact to one, which
travels, as its words, in a Spark join to its source chunk. The chunk walks it through its own edges: where the next edge
isn't the next one in the source document the path branches and a new span begins. So repeated nonbranching paths compact
to spans (document, start, words) = (source document, start), and the words at both coordinates are compared one by one.
Verified spans that follow each other are joined to the ranges of their path, which go back, one row a path and chunk, to
the documents: words are removed by these ranges alone. If any edge found no verified span (a hash collision), the whole
run starts again with another seed.

Null and empty texts have no words. Rows that share an id are never each other's source. A null id is after all others.
An empty table gives an empty result. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch
from tessera.llm._text import as_buffer, mix, pieces, shingle_hashes, word_hashes, words
from tessera.llm.chunks import Plan, bucket_edges, by_bucket, ordered, pack, plan_ranges, unpack


def _words(table: pa.Table, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, words of each text, word hashes if asked for)."""
    data, offsets = as_buffer(table["text"])
    starts, ends, counts, hashes = [], [], [], []
    for a, _, d, o in pieces(data, offsets):
        st, en, c = words(d, o)
        if hashed:
            hashes.append(word_hashes(d, st, en))
        starts.append(st + offsets[a])
        ends.append(en + offsets[a])
        counts.append(c)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return data, join(starts, np.int64), join(ends, np.int64), join(counts, np.int64), join(hashes, np.uint64)


def _edges(table: pa.Table, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, words of each text, edge hash, edge's text, edge's first word)."""
    data, starts, ends, counts, hashes = _words(table)
    if seed:
        hashes = mix(hashes + np.uint64(seed))
    return data, starts, ends, counts, *shingle_hashes(hashes, counts, k)


def _group_ids(table: pa.Table) -> np.ndarray:
    """A number for each row that grows with its id and is shared by equal ids."""
    ids = table["id"].combine_chunks() if table["id"].num_chunks != 1 else table["id"].chunk(0)
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
    return np.cumsum(new) - 1


def _send(k: int, bits: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        keys = np.unique(_edges(table, k, seed)[4])
        edges = bucket_edges(keys, bits)
        own = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
        return pa.table({"bucket": pa.array(own, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(own), pa.int32()), "keys": pa.array([pack(keys[edges[b] : edges[b + 1]]) for b in own], pa.binary())})

    return run


def _answer(ranges: int):
    """For each chunk, which of its keys an earlier chunk has, and the first that has. Chunks from ``ranges`` on are all
    after the others, none before another."""

    def run(table: pa.Table) -> pa.Table:
        return _firsts(table, ranges)

    return run


def _firsts(table: pa.Table, ranges: int) -> pa.Table:
    chunks = table["chunk"].to_numpy()
    order = np.argsort(chunks, kind="stable")
    parts = [unpack(table["keys"][int(i)].as_py()) for i in order]
    sizes = [len(p) for p in parts]
    keys, whose = np.concatenate(parts), np.repeat(chunks[order], sizes)
    by = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[by][1:] != keys[by][:-1]
    first = np.empty(len(keys), np.int32)
    first[by] = whose[by][np.flatnonzero(new)][np.cumsum(new) - 1]
    seen = first < np.minimum(whose, ranges)
    cut = np.concatenate(([0], np.cumsum(sizes)))
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    return pa.table(
        {
            "chunk": pa.array(chunks[order], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(parts), pa.int32()),
            "seen": pa.array([np.packbits(seen[a:b]).tobytes() for a, b in spans], pa.binary()), "source": pa.array([first[a:b][seen[a:b]].tobytes() for a, b in spans], pa.binary()),
        }
    )


def _find(k: int, bits: int, seed: int, id_type: pa.DataType):
    """A row for each distinct path of the chunk: its source chunk, its edges, its words, and where the chunk has it."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        chunk = table["chunk"][0].as_py()
        table = ordered(table)
        data, starts, ends, counts, values, owner, at = _edges(table, k, seed)
        keys, first, inverse = np.unique(values, return_index=True, return_inverse=True)
        edges = bucket_edges(keys, bits)
        source = np.full(len(keys), -1, np.int32)
        for r in by_bucket(replies):
            a, b = edges[r["bucket"]], edges[r["bucket"] + 1]
            seen = np.unpackbits(np.frombuffer(r["seen"], np.uint8), count=int(b - a)).astype(bool)
            source[a:b][seen] = np.frombuffer(r["source"], np.int32)
        group = _group_ids(table)
        src = source[inverse]
        here = (src < 0) & (group[owner] > group[owner[first]][inverse]) if len(values) else np.zeros(0, bool)
        src = np.where(here, chunk, src)

        # paths: consecutive repeated edges of one text with one source chunk
        which = np.flatnonzero(src >= 0)
        fresh = np.ones(len(which), bool)
        fresh[1:] = (at[which][1:] != at[which][:-1] + 1) | (owner[which][1:] != owner[which][:-1]) | (src[which][1:] != src[which][:-1])
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, len(which)))
        w0, row, goal = at[which[begin]], owner[which[begin]], src[which[begin]]
        distinct: dict[tuple[int, bytes], int] = {}
        path = np.array([distinct.setdefault((c, data[starts[a] : ends[a + n + k - 2]].tobytes()), len(distinct)) for c, a, n in zip(goal.tolist(), w0, length, strict=True)], np.int64)
        by = np.argsort(path, kind="stable")
        one = by[np.flatnonzero(np.diff(path[by], prepend=-1))]
        cut = pa.array(np.concatenate(([0], np.cumsum(np.bincount(path, minlength=len(distinct))))), pa.int32())
        first_word = np.concatenate(([0], np.cumsum(counts)))
        ids = table["id"].combine_chunks().cast(id_type).take(pa.array(row[by]))
        lists = [pa.ListArray.from_arrays(cut, x) for x in (ids, pa.array(row[by], pa.int32()), pa.array((w0 - first_word[row])[by], pa.int64()))]
        return pa.table([pa.array(np.full(len(one), chunk), pa.int32()), pa.array(goal[one], pa.int32()), pa.array(length[one], pa.int64()), pa.array([p for _, p in distinct], pa.binary()), *lists], names)

    names = ["own", "chunk", "edges", "path", "ids", "rows", "starts"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return run


def _remove(id_type: pa.DataType):
    """A row for each document, without the words in the ranges lo to hi of the paths that start at its ``starts``."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (id_type, pa.int64(), pa.int64(), pa.string())], names)
        table = ordered(table)
        data, starts, ends, counts, _ = _words(table, hashed=False)
        first_word = np.concatenate(([0], np.cumsum(counts)))
        places = pc.list_value_length(found["rows"]).to_numpy()
        begin = first_word[pc.list_flatten(found["rows"]).to_numpy()] + pc.list_flatten(found["starts"]).to_numpy()
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, begin + np.repeat(found["lo"].to_numpy(), places), 1)
        np.add.at(cover, begin + np.repeat(found["hi"].to_numpy(), places), -1)
        gone = np.cumsum(cover[:-1]) > 0
        owner = np.repeat(np.arange(len(counts)), counts)
        removed = np.bincount(owner[gone], minlength=len(counts))
        kept = np.flatnonzero(~gone)
        last = np.ones(len(kept), bool)
        last[:-1] = owner[kept][1:] != owner[kept][:-1]
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, starts[kept], 1)
        np.add.at(inside, ends[kept], -1)
        stay = np.cumsum(inside[:-1]) > 0
        gaps = ends[kept[~last]]
        stay[gaps] = True
        text = data.copy()
        text[gaps] = 0x20
        sizes = np.bincount(owner[kept], weights=ends[kept] - starts[kept] + ~last, minlength=len(counts)).astype(np.int64)
        cut = np.concatenate(([0], np.cumsum(sizes)))
        out = text[stay].tobytes()
        shas = [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([table["id"].cast(id_type), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names)

    names = ["id", "n_words", "n_removed", "kept_sha256"]
    return run


def _check(k: int, seed: int, id_type: pa.DataType):
    """Spans of each path that came to its source chunk; ``same`` is whether all words agree."""

    def run(table: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["chunk", "pid", "at", "n_words", "src_id", "src_start", "same"]
        if not asks.num_rows or not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.string(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.bool_())], names)
        table = ordered(table)
        data, starts, ends, counts, values, owner, at = _edges(table, k, seed)
        keys, first = np.unique(values, return_index=True)
        first_word = np.concatenate(([0], np.cumsum(counts)))
        paths = pa.table({"text": asks["path"].cast(pa.large_binary()).combine_chunks().cast(pa.large_string())})
        p_data, p_starts, p_ends, p_counts, p_values, p_owner, p_at = _edges(paths, k, seed)
        found = np.minimum(np.searchsorted(keys, p_values), max(0, len(keys) - 1))
        place = first[found] if len(keys) else np.zeros(len(p_values), np.int64)
        there = keys[found] == p_values if len(keys) else np.zeros(len(p_values), bool)
        begin = np.ones(len(p_values), bool)
        begin[1:] = (p_owner[1:] != p_owner[:-1]) | (at[place][1:] != at[place][:-1] + 1) | (owner[place][1:] != owner[place][:-1])
        b = np.flatnonzero(begin)
        n = np.diff(np.append(b, len(p_values))) + k - 1
        # the words at both coordinates, one by one
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w, v = np.repeat(p_at[b], n) + step, np.repeat(at[place[b]], n) + step
        sizes = p_ends[w] - p_starts[w]
        fine = sizes == ends[v] - starts[v]
        sizes = np.where(fine, sizes, 0)
        byte = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        differ = p_data[np.repeat(p_starts[w], sizes) + byte] != data[np.repeat(starts[v], sizes) + byte]
        span = np.repeat(np.arange(len(b)), n)
        bad = np.bincount(np.repeat(span, sizes)[differ], minlength=len(b)) + np.bincount(span[~fine], minlength=len(b))
        p_first = np.concatenate(([0], np.cumsum(p_counts)))
        asker, source = p_owner[b], owner[place[b]]
        ids = table["id"].cast(id_type).take(pa.array(source))
        chunk = pa.array(np.full(len(b), table["chunk"][0].as_py()), pa.int32())
        return pa.table([chunk, asks["pid"].take(pa.array(asker)), pa.array(p_at[b] - p_first[asker]), pa.array(n), ids, pa.array(at[place[b]] - first_word[source]), pa.array((bad == 0) & there[b])], names)

    return run


def _verify(s: Scratch, plan: Plan, asks: DataFrame, k: int, seed: int, id_type: pa.DataType, kind: str) -> DataFrame:
    """The spans of distinct paths (chunk, pid, path). A chunk that many paths ask for is read by as many tasks as their
    bytes need, each with the chunk's text and its share of the paths."""
    load = asks.groupBy("chunk").agg(F.sum(F.octet_length("path")).alias("bytes"))
    parts = F.broadcast(load.select("chunk", (F.lit(1) + F.floor(F.col("bytes") / max(plan.size, 1 << 16))).cast("int").alias("parts")))  # a row a chunk, MOST_CHUNKS at most
    text = plan.table.join(parts, "chunk").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    paths = asks.join(parts, "chunk").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int")).drop("parts")
    spans = text.groupBy("chunk", "part").cogroup(paths.groupBy("chunk", "part")).applyInArrow(_check(k, seed, id_type), f"chunk int, pid string, at long, n_words long, src_id {kind}, src_start long, same boolean")
    return s.write(spans)


@dataclass(frozen=True)
class _Found:
    plan: Plan
    paths: DataFrame  # own, chunk, pid, ids, rows, starts: where chunk ``own`` has a path whose source is in ``chunk``
    spans: DataFrame  # chunk, pid, at, n_words, src_id, src_start: all verified


def _run(s: Scratch, df: DataFrame, k: int, id_col: str, text_col: str) -> _Found:
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    if kind not in _ARROW:
        raise TypeError(f"{id_col} must be a number, not {kind}")
    id_type = _ARROW[kind]
    plan = plan_ranges(s, plain)
    for seed in range(3):
        sent = plan.table.groupBy("chunk").applyInArrow(_send(k, plan.bits, seed), "bucket int, chunk int, keys binary")
        replies = s.write(sent.groupBy("bucket").applyInArrow(_answer(plan.ranges), "chunk int, bucket int, seen binary, source binary"))
        found = plan.table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_find(k, plan.bits, seed, id_type), f"own int, chunk int, edges long, path binary, ids array<{kind}>, rows array<int>, starts array<long>")
        found = s.write(found.withColumn("pid", F.md5("path")))
        s.drop(replies)
        distinct = s.write(found.groupBy("chunk", "path").agg(F.first("pid").alias("pid"), F.first("edges").alias("edges")))
        spans = _verify(s, plan, distinct.drop("edges"), k, seed, id_type, kind)
        wanted = distinct.agg(F.sum("edges")).first()[0]
        verified = spans.where("same").agg(F.sum(F.col("n_words") - (k - 1))).first()[0]
        s.drop(distinct)
        if wanted == verified:
            return _Found(plan, found.drop("path", "edges"), spans.drop("same"))
        s.drop(found, spans)
    raise RuntimeError("edges collided under three seeds")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "float": pa.float32()}


def remove_repeats(df: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, n_words, n_removed, kept_sha256.

    Removes each word that a window of k words covers whose words also start in a document with a smaller id; the ids
    must be numbers. Windows are judged on the input. Kept words are joined by one space before hashing.
    """
    found = _run(Scratch(df.sparkSession, "substring"), df, k, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    # the spans of a path follow each other without a gap, as all of its edges are in one
    ranges = found.spans.groupBy("chunk", "pid").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("n_words")).alias("hi"))
    covered = found.paths.drop("ids").join(ranges, ["chunk", "pid"]).select(F.col("own").alias("chunk"), "rows", "starts", "lo", "hi")
    docs = found.plan.table.groupBy("chunk").cogroup(covered.groupBy("chunk")).applyInArrow(_remove(_ARROW[kind]), f"id {kind}, n_words long, n_removed long, kept_sha256 string")
    return docs.withColumnRenamed("id", id_col)


def repeated_spans(df: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verified spans: id, start, n_words, src_id, src_start, in words; src is an earlier document with the same words."""
    found = _run(Scratch(df.sparkSession, "substring"), df, k, id_col, text_col)
    places = found.paths.select("chunk", "pid", F.explode(F.arrays_zip("ids", "starts")).alias("x"))
    both = places.join(found.spans, ["chunk", "pid"])
    return both.select(F.col("x.ids").alias(id_col), (F.col("x.starts") + F.col("at")).alias("start"), "n_words", "src_id", "src_start")
