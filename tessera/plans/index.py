"""Indexes: summary tables that prune rows before the exact distance, all with the exhaustive plan's answer.

An index is ordinary tables. ``rows`` has (id, series, word, node); ``nodes``, one row a node, what bounds all its
members. A search reads the rows once, sorted by node, in blocks that meet blocks of queries:

    nodes with bound <= limit -> words with bound <= limit -> exact distance -> top-k or range

all in the task that has the rows, so that only what is found is shuffled. For top-k the limit of each query comes from
a seed: the exact k-th distance inside the nodes whose bounds are least, which can't be less than the true k-th
distance. Strategies differ in words and nodes only:

=========  =====================================  ==================================================
sax        segment means, cut into symbols        one
isax       the same                               first bits of the symbols, more where a node is large
zorder     the same                               runs of the interleaved key, sorted
multiary   the same                               all bits so far of the segments that spread most
sfa        Fourier coefficients, cut              first bits of the first coefficients
eapca      means and deviations of segments       signs of the means against the global means
=========  =====================================  ==================================================
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DistanceType, Layout, QueryType, SearchConfig
from tessera.functions import kernels
from tessera.operators.search import QUERIES, envelopes, finish, matrix, not_beyond, repeats, scan
from tessera.operators.validate import as_queries, check_series

STRATEGIES = ("sax", "isax", "zorder", "multiary", "sfa", "eapca")
#: Nodes are filtered on the driver, so there are at most this many; larger nodes follow from more rows.
MOST_NODES = 100_000
#: Bounds of queries and nodes that the driver holds at once.
MOST_BOUNDS = 1 << 22


@dataclass(frozen=True)
class Summary:
    """How series become words, and what words say about distances."""

    strategy: str
    layout: Layout
    dim: int
    cuts: np.ndarray  # one row of breakpoints, or one for each coefficient; eapca: the sample's mean of each segment

    def words(self, x: np.ndarray) -> np.ndarray:
        """One row a series: uint8 symbols, or for eapca float64 means and deviations."""
        if self.strategy == "sfa":
            return kernels.quantize(kernels.fourier(x, self.layout.word_length, self.layout.skip_mean), self.cuts)
        if self.strategy == "eapca":
            return np.concatenate(kernels.sketch(x, self.layout.segments), axis=1)
        return kernels.symbolize(kernels.paa(x, self.layout.segments), self.cuts)

    def blind(self, config: SearchConfig) -> bool:
        """Whether words say nothing: these bound the Euclidean distance only."""
        return config.distance is DistanceType.DTW and self.strategy in ("sfa", "eapca")

    def ends(self, q: np.ndarray, config: SearchConfig) -> tuple[np.ndarray, np.ndarray]:
        """What of queries is compared to words, greatest and least: segment means of envelopes, coefficients or sketches."""
        if self.strategy == "eapca":
            both = np.concatenate(kernels.sketch(q, self.layout.segments), axis=1)
            return both, both
        if self.strategy == "sfa":
            both = kernels.fourier(q, self.layout.word_length, self.layout.skip_mean)
            return both, both
        upper, lower = envelopes(config, q)
        return kernels.paa(upper, self.layout.segments), kernels.paa(lower, self.layout.segments)

    def weights(self) -> np.ndarray:
        """What a squared gap counts."""
        if self.strategy == "sfa":
            return kernels.fourier_weights(self.dim, self.layout.word_length, self.layout.skip_mean)
        lengths = np.diff(kernels.edges(self.dim, self.layout.segments)).astype(float)
        return np.tile(lengths, 2) if self.strategy == "eapca" else lengths

    def tables(self, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """[segment][symbol][query] -> contribution to the bound; not for eapca."""
        table = kernels.sfa_tables(upper, self.cuts, self.weights()) if self.strategy == "sfa" else kernels.sax_tables(upper, lower, self.cuts, self.weights())
        return np.minimum(table, 1e30).astype(np.float32)

    def node_bounds(self, upper: np.ndarray, lower: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """By query and node a value that no distance to a member is less than; members' words lie between ``low`` and ``high``."""
        total = np.zeros((len(upper), len(low)))
        for j, weight in enumerate(self.weights()):
            if self.strategy == "eapca":
                first, last = low[:, j], high[:, j]
            else:
                cuts = np.concatenate(([-np.inf], self.cuts[j] if self.strategy == "sfa" else self.cuts, [np.inf]))
                first, last = cuts[low[:, j].astype(int)], cuts[high[:, j].astype(int) + 1]
            gap = np.maximum(first - upper[:, [j]], lower[:, [j]] - last)
            np.maximum(gap, 0, out=gap)
            gap *= gap
            gap *= weight
            total += gap
        return total


def loose(limits: np.ndarray) -> np.ndarray:
    """Bounds and distances are rounded differently."""
    return limits + 1e-9 * (1 + limits)


class Pruner:
    """The pairs that nodes and words leave, for ``scan``; travels to the tasks."""

    def __init__(self, summary: Summary, nodes: dict[str, np.ndarray], config: SearchConfig):
        self.summary, self.nodes, self.config = summary, nodes, config

    def start(self, q: np.ndarray):
        s, nodes = self.summary, self.nodes
        if s.blind(self.config):
            return lambda part, a, limits: (np.arange(len(limits)), None)
        upper, lower = s.ends(q, self.config)
        place = {bytes(k): j for j, k in enumerate(nodes["key"])}
        is_float = s.strategy == "eapca"
        root = np.sqrt(s.weights())
        tables = None if is_float else np.concatenate([s.tables(upper[a : a + QUERIES], lower[a : a + QUERIES]) for a in range(0, len(q), QUERIES)], axis=2)  # what is between is in double precision and larger
        symbols = 0 if is_float else tables.shape[1]
        by_product = not is_float and tables.shape[0] * symbols <= 512
        last: list = [None]

        def prune(part: pa.RecordBatch, a: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            if last[0] is not part:
                words = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64 if is_float else np.uint8).reshape(part.num_rows, -1)
                coded = part.column(3).dictionary_encode()
                here = np.array([place[bytes(k)] for k in coded.dictionary.to_pylist()])
                last[:] = [part, words * root if is_float else kernels.one_hot(words, symbols) if by_product else words, here, coded.indices.to_numpy()]
            _, words, here, of = last
            limits = loose(limits)
            b = a + len(limits)
            near = ~(s.node_bounds(upper[a:b], lower[a:b], nodes["low"][here], nodes["high"][here]) > limits[:, None])
            use = np.flatnonzero(near.any(axis=1))
            if not len(use):
                return use, None
            near, limits = near[use], limits[use]
            if is_float:
                mask = not_beyond(upper[a + use] * root, words, limits)
            else:
                if by_product:
                    bound = tables[:, :, a + use].reshape(-1, len(use)).T @ words.T
                else:
                    bound = np.zeros((len(use), len(words)), np.float32)
                    for j in range(tables.shape[0]):
                        bound += np.ascontiguousarray(tables[j][:, a + use]).take(words[:, j], axis=0).T
                with np.errstate(over="ignore"):
                    most = np.nextafter((limits * (1 + 4e-6)).astype(np.float32), np.float32(np.inf))  # single precision adds at most 1e-6
                mask = ~(bound > most[:, None])
            return use, mask if near.all() else mask & near[:, of]

        return prune


class Seeds:
    """The pairs of each query and the rows of its nearest nodes, for ``scan``."""

    def __init__(self, keys: np.ndarray, asked: np.ndarray, node: np.ndarray):
        order = np.lexsort((asked, node))
        asked, node = asked[order], node[order]
        found, at = np.unique(node, return_index=True)
        self.queries = {bytes(keys[j]): x for j, x in zip(found, np.split(asked, at[1:]), strict=True)}

    def start(self, q: np.ndarray):
        def prune(part: pa.RecordBatch, a: int, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            coded = part.column(3).dictionary_encode()
            of = coded.indices.to_numpy()
            wanted = [(j, x) for j, x in enumerate(self.queries.get(bytes(k)) for k in coded.dictionary.to_pylist()) if x is not None]
            wanted = [(j, x[(x >= a) & (x < a + len(limits))] - a) for j, x in wanted]
            use = np.unique(np.concatenate([x for _, x in wanted])) if wanted else np.zeros(0, np.int64)
            mask = np.zeros((len(use), part.num_rows), bool)
            for j, x in wanted:
                mask[np.ix_(np.searchsorted(use, x), np.flatnonzero(of == j))] = True
            return use, mask

        return prune


def learn(series: DataFrame, strategy: str, layout: Layout, dim: int, n: int) -> Summary:
    """Breakpoints from a sample of at most ``layout.sample`` rows (a hash of the id draws it); Gaussian ones need none."""
    symbols = 1 << (layout.alphabet_bits if strategy == "sfa" else layout.bits)
    if layout.normalized and strategy not in ("sfa", "eapca"):
        return Summary(strategy, layout, dim, kernels.gaussian_breakpoints(symbols))
    share = min(1.0, layout.sample / max(n, 1))
    drawn = series.where(F.xxhash64(F.lit(11), "id").bitwiseAND(2**31 - 1) < int(share * 2**31)).select("series").limit(layout.sample).toArrow()  # packed: no object a number on the driver
    x = matrix(drawn.column(0).combine_chunks(), dim) if drawn.num_rows else np.zeros((1, dim))
    x = x[np.lexsort(x.T[::-1])]
    if strategy == "eapca":
        return Summary(strategy, layout, dim, kernels.paa(x, layout.segments).mean(axis=0))
    if strategy != "sfa":
        return Summary(strategy, layout, dim, kernels.equidepth_breakpoints(kernels.paa(x, layout.segments).ravel(), symbols))
    f = np.sort(kernels.fourier(x, layout.word_length, layout.skip_mean), axis=0)
    if layout.equal_depth_bins:
        cuts = f[(np.arange(1, symbols) * len(f)) // symbols].T
    else:
        cuts = (f[0] + np.arange(1, symbols)[:, None] * (f[-1] - f[0]) / symbols).T
    return Summary(strategy, layout, dim, np.ascontiguousarray(cuts))


@dataclass
class Index:
    summary: Summary
    rows: DataFrame  # id, series, word, node
    nodes: dict[str, np.ndarray] = field(repr=False)  # key, size, low, high
    n: int = 0
    prefix: int = 0  # bits of the key that name a node
    once: bool = False  # whether ids are known to have one row each


def _encode(summary: Summary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words = summary.words(matrix(b.column(1), summary.dim))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(node_keys(summary, words), pa.binary())], ["id", "series", "word", "key"])

    return run


def node_keys(summary: Summary, words: np.ndarray) -> list[bytes]:
    """The finest node of each word, as bytes whose prefixes are its parents."""
    if summary.strategy == "eapca":
        s = summary.layout.segments
        return [r.tobytes() for r in (words[:, :s] > summary.cuts).astype(np.uint8)]
    bits = summary.layout.alphabet_bits if summary.strategy == "sfa" else summary.layout.bits
    if summary.strategy == "multiary":
        return [r.tobytes() for r in words]
    return kernels.z_key(words, bits)


def encode(series: DataFrame, summary: Summary) -> DataFrame:
    """(id, series, word, key): a projection, so appended rows get the words that a rebuild would give them."""
    return series.select(F.col("id").cast("long").alias("id"), "series").mapInArrow(_encode(summary), "id long, series array<float>, word binary, key binary")


def _nodes(rows: DataFrame, summary: Summary) -> dict[str, np.ndarray]:
    """Size and bounding box of each node; boxes are merged by task first, so a node costs a row a task."""
    is_float = summary.strategy == "eapca"

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            of, w = coded.indices.to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64 if is_float else np.uint8).reshape(b.num_rows, -1)
            by = np.argsort(of, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], of[by][1:] != of[by][:-1])))
            low, high, size = np.minimum.reduceat(w[by], start), np.maximum.reduceat(w[by], start), np.diff(start, append=len(by))
            for i, key in enumerate(coded.dictionary.take(pa.array(of[by][start])).to_pylist()):
                if (box := found.get(key)) is None:
                    found[key] = [int(size[i]), low[i], high[i]]
                else:
                    box[0] += int(size[i])
                    box[1], box[2] = np.minimum(box[1], low[i]), np.maximum(box[2], high[i])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), *(pa.array([x[i].astype(np.float64).tolist() for x in found.values()], pa.list_(pa.float64())) for i in (1, 2))], ["node", "size", "low", "high"])

    width = len(summary.words(np.zeros((1, summary.dim)))[0])
    parts = rows.select("node", "word").mapInArrow(boxes, "node binary, size long, low array<double>, high array<double>")
    merged = parts.groupBy("node").agg(F.sum("size").alias("size"), *(F.min(F.get("low", i)).alias(f"l{i}") for i in range(width)), *(F.max(F.get("high", i)).alias(f"h{i}") for i in range(width)))
    got = merged.limit(MOST_NODES + 1).collect()
    if len(got) > MOST_NODES:
        raise ValueError("too many nodes; raise leaf_size")
    got.sort(key=lambda r: bytes(r["node"]))
    return {
        "key": np.array([bytes(r["node"]) for r in got], dtype=object), "size": np.array([r["size"] for r in got], np.int64),
        "low": np.array([[r[f"l{i}"] for i in range(width)] for r in got]).reshape(len(got), width), "high": np.array([[r[f"h{i}"] for i in range(width)] for r in got]).reshape(len(got), width),
    }


def _prefix_length(coded: DataFrame, layout: Layout, n: int, width: int) -> int:
    """The bits of the shortest prefix of the key that cuts the rows into nodes of ``leaf_size`` on average; counted, not guessed."""
    if n <= layout.leaf_size:
        return 0

    def first(lengths: list[int]) -> tuple[int, bool]:
        """The first of the lengths that is enough, or the last before there are too many nodes; whether it is enough."""
        counts, before = coded.agg(*(F.approx_count_distinct(node(i)).alias(f"p{i}") for i in lengths)).first(), lengths[0] - (lengths[1] - lengths[0])
        for i in lengths:
            if counts[f"p{i}"] > MOST_NODES // 2:
                return before, False
            if counts[f"p{i}"] * layout.leaf_size >= n:
                return i, True
            before = i
        return before, True

    whole, enough = first(list(range(8, 8 * width + 1, 8))) if width > 1 else (8, True)
    whole += 0 if enough else 8
    return max(0, first(list(range(whole - 7, whole + 1)))[0])


def node(bits: int) -> Column:
    """The first bits of the key, filled up to bytes."""
    whole, rest = divmod(bits, 8)
    head = F.substring("key", 1, whole) if whole else F.lit(b"")
    if not rest:
        return head
    byte = F.conv(F.hex(F.substring("key", whole + 1, 1)), 16, 10).cast("long").bitwiseAND(256 - (1 << (8 - rest)))
    return F.concat(head, F.unhex(F.lpad(F.hex(byte), 2, "0")))


def build(series: DataFrame, strategy: str, layout: Layout | None = None, store=None) -> Index:
    """Builds an index over (id, series). ``store``: a function that writes a table and returns it read back, else cached.

    Rows are range-partitioned and sorted by key, so that Parquet's statistics prune what a node filter excludes.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    layout = layout or Layout()
    n, dim = check_series(series)
    if n:
        layout.check(dim, strategy)
    summary = learn(series, strategy, layout, dim, n)
    coded = encode(series, summary)
    width = {"multiary": layout.split_segments, "eapca": layout.segments, "sax": 0}.get(strategy)
    if width is None:
        bits = layout.alphabet_bits if strategy == "sfa" else layout.bits
        width = -(-(layout.word_length if strategy == "sfa" else layout.segments) * bits // 8)
    if strategy == "multiary" and n:
        coded = coded.withColumn("key", F.concat(*(F.substring("key", int(s) + 1, 1) for s in _spread_segments(coded, layout))))
    length = _prefix_length(coded, layout, n, width) if width else 0
    rows = coded.withColumn("node", node(length)).orderBy("key", "id").select("id", "series", "word", "node")
    rows = store(rows) if store else rows.cache()
    return Index(summary, rows, _nodes(rows, summary), n, length, not repeats(rows))


def _spread_segments(coded: DataFrame, layout: Layout) -> list[int]:
    """The segments whose symbols spread most, widest first."""
    symbol = [F.conv(F.hex(F.substring("word", i + 1, 1)), 16, 10).cast("int") for i in range(layout.segments)]
    r = coded.agg(*(F.stddev_pop(s).alias(f"s{i}") for i, s in enumerate(symbol))).first()
    return sorted(range(layout.segments), key=lambda i: (-(r[f"s{i}"] or 0), i))[: layout.split_segments]


def append(index: Index, series: DataFrame, store=None) -> Index:
    """Adds rows under the words and nodes that were learned at the build; ids must be new."""
    added, dim = check_series(series)
    if not added:
        return index
    if dim != index.summary.dim:
        raise ValueError(f"series must have length {index.summary.dim}")
    coded = encode(series, index.summary)
    rows = coded.withColumn("node", node(0 if index.summary.strategy == "multiary" else index.prefix)).select("id", "series", "word", "node")
    rows = index.rows.unionByName(store(rows) if store else rows.cache())
    return Index(index.summary, rows, _nodes(rows, index.summary), index.n + added, index.prefix, index.once and not repeats(rows))


def search(index: Index, queries, config: SearchConfig) -> DataFrame:
    """Filter and refine; the rows are those of the exhaustive search."""
    config.check()
    s = index.summary
    qids, q = as_queries(queries, s.dim)
    if config.type is QueryType.TOP_K and config.k > index.n:
        raise ValueError("k is more than the number of series")
    bounds = _seed(index, qids, q, config) if config.type is QueryType.TOP_K else None
    rows, n = index.rows, len(index.nodes["key"])
    if n <= 2000 and n * len(q) <= MOST_BOUNDS:  # few queries may leave few nodes, and files have statistics of these
        limits = np.full(len(q), config.r) if bounds is None else bounds
        wanted = [(x <= loose(limits[a : a + len(x)])[:, None]).any(axis=0) for a, x in _node_bounds(index, q, config)][0]
        if not wanted.all():
            rows = rows.where(F.col("node").isin([bytes(k) for k in index.nodes["key"][wanted]]))
    return finish(scan(rows, qids, q, config, bounds, Pruner(s, index.nodes, config)), config, index.once)


def _node_bounds(index: Index, q: np.ndarray, config: SearchConfig) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, bounds by query and node), so many queries at once that memory doesn't grow with them."""
    s, low, high = index.summary, index.nodes["low"], index.nodes["high"]
    step = max(1, MOST_BOUNDS // max(1, len(low)))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        yield a, np.zeros((len(part), len(low))) if s.blind(config) else s.node_bounds(*s.ends(part, config), low, high)


def candidate_pairs(index: Index, queries, config: SearchConfig) -> int:
    """How many (query, row) pairs are in nodes that are not pruned, of ``index.n`` times the queries."""
    qids, q = as_queries(queries, index.summary.dim)
    limits = _seed(index, qids, q, config) if config.type is QueryType.TOP_K else np.full(len(q), config.r)
    return sum(int(((x <= limits[a : a + len(x), None]) * index.nodes["size"][None, :]).sum()) for a, x in _node_bounds(index, q, config))


def _seed(index: Index, qids: list[int], q: np.ndarray, config: SearchConfig) -> np.ndarray:
    """For each query the exact k-th distance among the nearest nodes that hold k rows together."""
    asked, near = [], []
    for a, x in _node_bounds(index, q, config):
        have, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(open_):
            j = x[open_].argmin(axis=1)
            asked.append(open_ + a)
            near.append(j)
            x[open_, j] = np.inf
            have[open_] += index.nodes["size"][j]
            open_ = open_[have[open_] < config.k]
    seeds = Seeds(index.nodes["key"], np.concatenate(asked), np.concatenate(near))
    rows = index.rows
    if len(seeds.queries) <= min(2000, len(index.nodes["key"]) // 2):
        rows = rows.where(F.col("node").isin(list(seeds.queries)))
    found = finish(scan(rows, qids, q, config, pruner=seeds), config, index.once).where(F.col("rank") == config.k).select("qid", "dist").toArrow()  # one number a query
    kth = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    return np.array([kth.get(i, np.inf) for i in qids])
