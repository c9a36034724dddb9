"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A document is its set of distinct k-word shingles (64-bit hashes). Sets of size n with Jaccard similarity t or more
share a token among the first n - ceil(t n) + 1 of both, whatever order the tokens are put in, as long as it is the
same for all. So candidates must share a prefix token under each of ``orders`` orders. All orders put rare tokens
first; they differ in how finely frequencies are told apart, and in a hash that orders equal ones.

1. Chunks of documents and hash buckets exchange their distinct tokens, so each chunk learns in how many sets (copies
   inside a chunk counted once) each of its tokens is. A token that is in one set only is in no pair: it takes its place
   in the prefixes, but isn't posted. So a document with more such tokens than its prefix is long is done here.
2. Equal sets are one class (128-bit digests); from here on a class is one node, however many copies it has. A class
   that is left has postings (prefix tokens of the first order), its prefixes under the other orders, and its set.
3. Classes meet in a native join by token. Its condition holds the size filter, the positional filter (a pair can only
   link if the places left after its first common token suffice), a bound on the symmetric difference from parity
   bits, and for frequent tokens that the two have no earlier prefix token in common: so a pair that can't link is no
   row, nor one that another token makes. The pairs then have to overlap in the prefixes of every other order, and
   the intersection of their sets is counted.
4. In each token's group one pivot meets all others first. Links hook classes into components; in a group that still
   holds several, one class of each component meets all other components; after that all classes outside the group's
   largest component do. Pairs under one component are not compared. So every pair that shares a first-order token was
   compared or was already connected: no component is lost, and g near copies cost about g comparisons, not g * g.
   ``similar_pairs`` leaves this step out and compares every pair.

A frequent token's group is dealt out over as many parts as its frequency asks for, and pivots are copied to all parts,
so no task holds a whole group. Null and empty texts have no shingles and link with nothing; with fewer than k words the
whole sequence is the one shingle. Repeated rows are one class. An empty table gives an empty result. Extra columns are
carried by position, so their names may clash with anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tessera.llm._shared import Scratch
from tessera.llm._text import LOWER, as_buffer, grouped_order, mix, pieces, sets, shingle_hashes, word_hashes, words
from tessera.llm.chunks import Plan, bucket_edges, by_bucket, ordered, pack, pack_counts, plan_chunks, unpack, unpack_counts
from tessera.llm.components import components

#: Classes in one part of a token's group.
PART = 4096
#: Level of a token whose postings say what is posted before them: that of 16 classes.
FREQUENT = 32
#: Words of 64 parity bits.
PARITY = 8
#: Key bits beyond those that number the corpus's tokens: one token in 2^SPARE shares its key by chance.
SPARE = 14
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, counts = words(low, offsets)
    values, owner, _ = shingle_hashes(word_hashes(low, starts, ends), counts, k, short=True)
    return sets(values, owner, len(counts))


@dataclass
class _Sets:
    """The sets of a chunk, one after the other, with their digests; ``rep``: the first of equal ones."""

    values: np.ndarray
    counts: np.ndarray
    d1: np.ndarray
    d2: np.ndarray
    rep: np.ndarray

    @staticmethod
    def of(table: pa.Table, k: int) -> _Sets:
        found = [shingle_sets(d, o, k) for _, _, d, o in pieces(*as_buffer(table["text"]))]
        values, counts = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, (np.uint64, np.int64)[i]) for i in (0, 1))
        some, starts = counts > 0, (np.cumsum(counts) - counts)
        d1, d2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
        if len(values):
            d1[some] = np.add.reduceat(mix(values + np.uint64(1)), starts[some])
            d2[some] = np.add.reduceat(mix(mix(values) ^ np.uint64(0x5DEECE66D)), starts[some])
        rep = np.zeros(len(counts), bool)
        by = np.lexsort((d2, d1, counts))
        first = np.ones(len(by), bool)
        first[1:] = (d1[by][1:] != d1[by][:-1]) | (d2[by][1:] != d2[by][:-1]) | (counts[by][1:] != counts[by][:-1])
        rep[by[first]] = True
        return _Sets(values, counts, d1, d2, rep & some)

    def tokens(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the chosen rows, and whose they are."""
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        use = rows[owner]
        return self.values[use], owner[use]


def _send(k: int, width: int, bits: int):
    """A chunk's distinct tokens, the top ``width`` bits of each, and in how many of its classes each is."""

    def run(table: pa.Table) -> pa.Table:
        own = _Sets.of(table, k)
        keys = np.sort(own.tokens(own.rep)[0]) >> np.uint64(64 - width)
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        keys, counts = keys[new], np.diff(new, append=len(keys))
        edges = bucket_edges(keys, bits, width)
        there = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
        cut = [slice(edges[b], edges[b + 1]) for b in there]
        return pa.table({"bucket": pa.array(there, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(there), pa.int32()), "keys": pa.array([pack(keys[c]) for c in cut], pa.binary()), "counts": pa.array([pack_counts(counts[c]) for c in cut], pa.binary())})

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """For each chunk, which of its tokens are in several classes, and the eighths of octaves of how many."""
    chunks = table["chunk"].to_numpy()
    parts = [unpack(x.as_py()) for x in table["keys"]]
    keys, counts = np.concatenate(parts), np.concatenate([unpack_counts(x.as_py()) for x in table["counts"]])
    by = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[by][1:] != keys[by][:-1]
    start = np.flatnonzero(new)
    level = np.zeros(len(keys), np.uint8)
    level[by] = np.minimum(255, np.floor(8 * np.log2(np.add.reduceat(counts[by], start)))).astype(np.uint8)[np.cumsum(new) - 1]
    cut = np.cumsum([0, *map(len, parts)])
    spans = [level[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(parts), pa.int32()), "many": pa.array([np.packbits(x > 0).tobytes() for x in spans], pa.binary()), "levels": pa.array([x[x > 0].tobytes() for x in spans], pa.binary())})


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def prefixes(values: np.ndarray, level: np.ndarray, owner: np.ndarray, counts: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the prefix tokens of each set are under an order, and their places in it. The first order tells all levels
    apart, the second octaves of frequency, the others four octaves."""
    coarse = level >> np.uint8((0, 3, 5)[min(order, 2)])
    coarse = np.where((level > 0) & (coarse == 0), 1, coarse).astype(np.uint64)
    rank = (coarse << np.uint64(56)) | (mix(values + np.uint64(order) * _GOLD) >> np.uint64(8))
    by = grouped_order(rank, owner)
    sizes = np.bincount(owner, minlength=len(counts))
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < prefix_length(counts, percent)[owner[by]]
    return by[keep], place[keep]


def _can_link(n: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of n tokens can link with another one than itself."""
    return 100 * n >= percent * (n + 1)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))), pa.int32()), pa.array(values.view(np.int64)))


def _post(k: int, percent: int, orders: int, width: int, bits: int, schema: pa.Schema):
    """Kind 0: a row; 1: a posting of a class of the chunk; 2: the set of such a class and its other prefixes."""

    def rows(kind: int, m: int, **columns) -> pa.Table:
        columns["kind"] = np.full(m, kind, np.int32)
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(m, f.type) for f in schema], schema=schema)

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows(0, 0)
        chunk, table = table["chunk"][0].as_py(), ordered(table)
        own = _Sets.of(table, k)
        row = (chunk << 32) + np.arange(table.num_rows)
        out = [rows(0, table.num_rows, row=row, n=own.counts, d1=own.d1.view(np.int64), d2=own.d2.view(np.int64), id=table["id"].combine_chunks())]
        values, owner = own.tokens(own.rep)
        by = np.argsort(values)
        keys = values[by] >> np.uint64(64 - width)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        distinct = keys[new]
        level, edges = np.zeros(len(distinct), np.uint8), bucket_edges(distinct, bits, width)
        for r in by_bucket(replies):
            a, b = edges[r["bucket"]], edges[r["bucket"] + 1]
            many = np.unpackbits(np.frombuffer(r["many"], np.uint8), count=int(b - a)).astype(bool)
            level[a:b][many] = np.frombuffer(r["levels"], np.uint8)
        of_token = np.empty(len(values), np.uint8)
        of_token[by] = level[np.cumsum(new) - 1]
        # a class whose prefix holds only tokens of its own has no candidates
        alone = np.bincount(owner[of_token == 0], minlength=table.num_rows)
        live = own.rep & _can_link(own.counts, percent) & (alone < prefix_length(own.counts, percent))
        use = live[owner]
        values, owner, of_token = values[use], owner[use], of_token[use]
        at, place = prefixes(values, of_token, owner, own.counts, 0, percent)
        shared = of_token[at] > 0
        at, place = at[shared], place[shared]
        bit = mix(values ^ _GOLD) >> np.uint64(64 - (64 * PARITY - 1).bit_length())
        parity = np.bincount(owner * (64 * PARITY) + bit.astype(np.int64), minlength=table.num_rows * 64 * PARITY) & 1
        parity = np.packbits(parity.astype(np.uint8).reshape(table.num_rows, PARITY, 64), axis=2).view(">i8").reshape(-1, PARITY).astype(np.int64)
        tokens, whose = values[at], owner[at]
        # what a class posts before a frequent token, so that a pair is made at its first common token only
        nth = np.arange(len(at)) - np.searchsorted(whose, whose)
        known = np.where(of_token[at] >= FREQUENT, nth, 0)
        ends = np.cumsum(known)
        flat = tokens[np.repeat(np.arange(len(at)) - nth, known) + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - known, known)]
        before = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat.view(np.int64)))
        parts = 1 + (np.exp2(of_token[at] / 8).astype(np.int64) // PART)
        part = (mix(row.astype(np.uint64))[whose] % parts.astype(np.uint64)).astype(np.int64)
        out.append(rows(1, len(at), row=row[whose], n=own.counts[whose], token=tokens.view(np.int64), place=place, parts=parts, part=part, before=before, **{f"p{i}": parity[whose, i] for i in range(PARITY)}))
        who = np.flatnonzero(live)
        others = {}
        for m in range(1, orders):
            x, _ = prefixes(values, of_token, owner, own.counts, m, percent)
            x = x[of_token[x] > 0]
            others[f"o{m}"] = _lists(values[x], np.searchsorted(who, owner[x]), len(who))
        cut = np.concatenate(([0], np.cumsum(own.counts[who])))
        out.append(rows(2, len(who), row=row[who], set=[values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], **others))
        return pa.concat_tables(out)

    return run


def _verify(percent: int):
    """The pairs (a, b, set of a, set of b) whose sets link, with the size of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                m = part.num_rows
                blobs = [part.column(i).to_pylist() for i in (2, 3)]
                sizes = [np.array([len(x) // 8 for x in b], np.int64) for b in blobs]
                both = np.concatenate([np.frombuffer(b"".join(b), np.uint64) for b in blobs])
                owner = np.concatenate([np.repeat(np.arange(m), n) for n in sizes])
                by = grouped_order(both, owner)
                both, owner = both[by], owner[by]
                shared = np.bincount(owner[1:][(both[1:] == both[:-1]) & (owner[1:] == owner[:-1])], minlength=m)
                linked = pa.array(100 * shared >= percent * (sizes[0] + sizes[1] - shared))
                yield pa.RecordBatch.from_arrays([x.filter(linked) for x in (part.column(0), part.column(1), pa.array(sizes[0]), pa.array(sizes[1]), pa.array(shared))], ["a", "b", "na", "nb", "shared"])

    return run


@dataclass(frozen=True)
class _Candidates:
    plan: Plan
    docs: DataFrame  # row, n, d1, d2, id
    classes: DataFrame  # d1, d2, n, cls, min_id, first
    posts: DataFrame  # token, cls, n, place, parts, part, p0...
    sets: DataFrame  # cls, set, o1...


def _candidates(s: Scratch, plain: DataFrame, k: int, percent: int, orders: int) -> _Candidates:
    plan = plan_chunks(plain)
    width = max(plan.bits, min(64, max(1, plan.total // 6).bit_length() + SPARE))
    sent = plan.table.select("chunk", "id", "text").groupBy("chunk").applyInArrow(_send(k, width, plan.bits), "bucket int, chunk int, keys binary, counts binary")
    replies = s.write(sent.groupBy("bucket").applyInArrow(_frequencies, "chunk int, bucket int, many binary, levels binary"))
    others = ", ".join(f"o{m} array<long>" for m in range(1, orders))
    id_type = plain.schema["id"].dataType
    kinds = f"kind int, row long, n long, d1 long, d2 long, id {id_type.simpleString()}, token long, place long, parts long, part long, before array<long>, {', '.join(f'p{i} long' for i in range(PARITY))}, set binary{', ' + others if others else ''}"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(plain.sparkSession.createDataFrame([], kinds).schema)
    made = plan.table.select("chunk", "id", "text").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_post(k, percent, orders, width, plan.bits, schema), kinds)
    made = s.write(made)
    s.drop(replies)
    docs = made.where("kind = 0").select("row", "n", "d1", "d2", "id")
    alike = docs.where("n > 0").groupBy("d1", "d2", "n")
    classes = s.write(alike.agg(F.min("row").alias("cls"), F.min("id").alias("min_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")))
    chosen = classes.select(F.col("cls").alias("row"))
    posts = made.where("kind = 1").join(chosen, "row", "left_semi").select("token", F.col("row").alias("cls"), "n", "place", "parts", "part", "before", *(f"p{i}" for i in range(PARITY)))
    found = made.where("kind = 2").select(F.col("row").alias("cls"), "set", *(f"o{m}" for m in range(1, orders)))
    return _Candidates(plan, docs, classes, s.write(posts), found)


def _meet(pivots: DataFrame, posts: DataFrame, percent: int, also: Column) -> DataFrame:
    """Pairs of a pivot and another class in the same group that pass the filters, each once, the lesser class first.

    ``pivots`` and ``posts`` have the columns of postings and ``comp``; ``also`` may use them with the prefixes a_ and b_.
    """
    a = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    a = a.select(*(F.col(c).alias(c if c in ("token", "part") else f"a_{c}") for c in a.columns))
    b = posts.select(*(F.col(c).alias(c if c in ("token", "part") else f"b_{c}") for c in posts.columns))
    n = F.col("a_n") + F.col("b_n")
    differ = sum((F.bit_count(F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}"))) for i in range(PARITY)), F.lit(0))
    fit = [
        F.col("a_cls") != F.col("b_cls"), also,
        100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"),
        (100 + percent) * F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= percent * n,
        (100 + percent) * differ <= (100 - percent) * n,
        ~F.arrays_overlap("a_before", "b_before"),
    ]
    same = [F.col("a.token") == F.col("b.token"), F.col("a.part") == F.col("b.part")]
    on = same[0]
    for c in [*same[1:], *fit]:
        on = on & c
    return a.alias("a").join(b.alias("b"), on).select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b")).distinct()


def _links(c: _Candidates, pairs: DataFrame, percent: int, orders: int) -> DataFrame:
    names = [f"o{m}" for m in range(1, orders)]
    one = c.sets.select(F.col("cls").alias("a"), F.col("set").alias("sa"), *(F.col(o).alias(f"a_{o}") for o in names))
    two = c.sets.select(F.col("cls").alias("b"), F.col("set").alias("sb"), *(F.col(o).alias(f"b_{o}") for o in names))
    both = pairs.join(one, "a").join(two, "b")
    for o in names:
        both = both.where(F.arrays_overlap(f"a_{o}", f"b_{o}"))
    return both.select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long, na long, nb long, shared long")


def _components(s: Scratch, c: _Candidates, percent: int, orders: int) -> DataFrame:
    """(node, comp) of every class that links with another."""
    lead = F.min_by(F.struct(*(x for x in c.posts.columns if x not in ("token", "part"))), F.struct(F.xxhash64("cls"), "cls"))
    star = c.posts.groupBy("token").agg(lead.alias("x")).select("token", "x.*")
    every = s.write(_links(c, _meet(star, c.posts, percent, F.lit(True)), percent, orders).select("a", "b"))
    label = components(s, every.toDF("u", "v"))
    left = c.posts
    for step in ("star 1", "star 2", "each", "all"):
        named = left.drop("comp").join(label.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        alive = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        left = s.write(named.join(alive, "token", "left_semi"))
        if not left.limit(1).count():
            break
        if step.startswith("star"):  # another pivot, before the classes that the first left out meet all others
            again = F.min_by(F.struct(*(x for x in left.columns if x not in ("token", "part"))), F.struct(F.xxhash64(F.lit(step), "cls"), "cls"))
            pivots = left.groupBy("token").agg(again.alias("x")).select("token", "x.*")
            more = s.write(_links(c, _meet(pivots, left, percent, F.col("a_comp") != F.col("b_comp")), percent, orders).select("a", "b"))
            every = every.unionByName(more)
            label = components(s, every.toDF("u", "v"))
            continue
        if step == "all":
            sizes = left.groupBy("token", "comp").agg(F.count("*").alias("size"))
            most = sizes.groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
            left = left.join(most, "token").withColumn("pivot", F.col("comp") != F.col("main")).drop("main")
        else:
            first = left.groupBy("token", "comp").agg(F.min_by("cls", F.struct(F.xxhash64("cls"), "cls")).alias("cls")).select("token", "cls", F.lit(True).alias("pivot"))
            left = left.join(first, ["token", "cls"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
        left = s.write(left)
        also = (F.col("a_comp") != F.col("b_comp")) & (~F.col("b_pivot") | (F.col("a_cls") < F.col("b_cls")))
        more = s.write(_links(c, _meet(left.where("pivot"), left, percent, also), percent, orders).select("a", "b"))
        every = every.unionByName(more)
        if more.limit(1).count():
            label = components(s, every.toDF("u", "v"))
        left = left.where("not pivot").drop("pivot")
    return label


def _keep(names: list[str], schema: pa.Schema):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        table, found = ordered(table), found.sort_by("row")
        columns = [*(table[n] for n in names), *(found[c] for c in ("n", "component_id", "kept"))]
        return pa.table([c.combine_chunks().cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, orders: int = 3, id_col: str = "doc_id", text_col: str = "text", keep_all: bool = False) -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id (the least id it reaches by links, its own included).

    With ``keep_all`` all columns of ``df`` come along, and ``kept``: one row of each component, the one of least id.
    """
    s = Scratch(df.sparkSession, "jaccard")
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    c = _candidates(s, plain, k, percent, orders)
    label = _components(s, c, percent, orders)
    named = c.classes.join(label.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    comps = named.groupBy("comp").agg(F.min("min_id").alias("component_id"), F.min("first").alias("first"))
    reach = s.write(named.select("d1", "d2", "n", "comp").join(comps, "comp").select("d1", "d2", "n", "component_id", F.col("first.row").alias("first")))
    out = c.docs.join(reach, ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    if not keep_all:
        return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    found = s.write(out.select(F.shiftright("row", 32).cast("int").alias("chunk"), "row", "n", component.alias("component_id"), ((F.col("n") == 0) | (F.col("row") == F.col("first"))).alias("kept")))
    inner = [f"x{i}" for i in range(len(df.columns))]
    wide = df.toDF(*inner).withColumns({"id": F.col(inner[df.columns.index(id_col)]), "text": F.col(inner[df.columns.index(text_col)])})
    table = c.plan.deal(wide)
    fields = [StructField(n, f.dataType) for n, f in zip(inner, df.schema)]
    result = StructType([*fields, StructField("n", LongType()), StructField("component_id", df.schema[id_col].dataType), StructField("kept", BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    marked = table.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_keep(inner, to_arrow_schema(result)), result)
    return marked.toDF(*df.columns, "n_shingles", "component_id", "kept")


def similar_pairs(df: DataFrame, k: int = 5, percent: int = 80, orders: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and who has them: (a, b, na, nb, shared), a < b being classes of equal sets with
    their sizes and that of the intersection; and (id, class), the class null for a row without shingles.

    Here no pair is left out as already connected, so g near copies give up to g * g / 2 rows.
    """
    s = Scratch(df.sparkSession, "jaccard")
    c = _candidates(s, df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k, percent, orders)
    pairs = _links(c, _meet(c.posts, c.posts, percent, F.col("a_cls") < F.col("b_cls")), percent, orders)
    members = c.docs.join(c.classes.select("d1", "d2", "n", F.col("cls").alias("class")), ["d1", "d2", "n"], "left")
    return pairs, members.select(F.col("id").alias(id_col), "class")
