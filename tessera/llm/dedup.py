"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of ``block`` bytes. Equal blocks are sorted together and get one integer name, the
least occurrence in their run; then adjacent names are paired, equal pairs get one name, and so on until a text has one
name left. Names stand for bytes, not for hashes of them, so texts of one length and one name are equal: no collisions.

One Python pass names blocks inside bounded chunks of the input first, so that a block that a third of all texts share
reaches the shuffle once a chunk, and a text that repeats inside a chunk is named once. Everything after that pass
works on integers in Spark joins.

Null counts as empty. Rows that repeat an id and its text are told apart, and one of them stays. An empty table gives
an empty result. Only ``id_col`` and ``text_col`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch

BLOCK = 1024
#: Bytes of distinct blocks after which a chunk's dictionary is emitted and emptied.
CHUNK = 32 << 20
#: Dropped ids that may be broadcast, 16 bytes each.
FEW = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOCAL = "kind int, id {id}, row long, cls long, n int, reps array<long>, rep long, block binary, sha string"
_FIELDS = ["kind", "id", "row", "cls", "n", "reps", "rep", "block", "sha"]


def _local_names(block: int, chunk: int, kind: str):
    """Kind 0: a distinct block of a chunk; 1: a distinct text, as blocks; 2: a row and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        n_rows = n_names = held = 0
        names: dict[bytes, int] = {}
        texts: dict[tuple[int, ...], int] = {}

        def rows(k: int, m: int, /, **columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int32()), *(pa.array(columns[f], types[f]) if f in columns else pa.nulls(m, types[f]) for f in _FIELDS[1:])], _FIELDS)

        types = {"row": pa.int64(), "cls": pa.int64(), "n": pa.int32(), "reps": pa.list_(pa.int64()), "rep": pa.int64(), "block": pa.binary(), "sha": pa.string()}
        for batch in batches:
            types["id"] = batch.column(0).type
            shas, classes, fresh, fresh_text = [], [], [], []
            for text in batch.column(1):
                raw = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower()
                shas.append(hashlib.sha256(raw).hexdigest())
                key = []
                for i in range(0, max(1, len(raw)), block):
                    b = raw[i : i + block]
                    if (name := names.get(b)) is None:
                        name = names[b] = base + n_names
                        n_names += 1
                        held += len(b) + 100
                        fresh.append((name, b))
                    key.append(name)
                if (cls := texts.get(k := tuple(key))) is None:
                    cls = texts[k] = base + n_rows + len(classes)
                    held += 8 * len(k) + 100
                    fresh_text.append((cls, key))
                classes.append(cls)
            if fresh:
                yield rows(0, len(fresh), rep=[r for r, _ in fresh], block=[b for _, b in fresh])
            if fresh_text:
                yield rows(1, len(fresh_text), cls=[c for c, _ in fresh_text], n=[len(k) for _, k in fresh_text], reps=[k for _, k in fresh_text])
            if classes:
                yield rows(2, len(classes), id=batch.column(0), row=[base + n_rows + i for i in range(len(classes))], cls=classes, sha=shas)
            n_rows += len(classes)
            if held > chunk:
                names.clear()
                texts.clear()
                held = 0

    return run


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. Of equal texts the row with the largest id stays; of
    rows that also share that id, one. A null id is less than any other.
    """
    s = Scratch(df.sparkSession, "dedup")
    kind = df.schema[id_col].dataType.simpleString()
    local = s.write(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_local_names(block, chunk, kind), _LOCAL.format(id=kind)))

    found = local.where("kind = 0").select("block", "rep")
    least = found.groupBy("block").agg(F.min("rep").alias("name"))
    names = s.write(found.join(least, "block").select("rep", "name"))
    level = local.where("kind = 1").select("cls", "n", F.posexplode("reps").alias("i", "rep")).join(names, "rep").select("cls", "n", F.col("n").alias("m"), "i", "name")
    level = s.write(level)
    s.drop(names)
    done = []
    while True:
        done.append(level.where("m = 1").select("cls", "n", "name"))
        if not level.where("m > 1").limit(1).count():
            break
        of = [F.max(F.when(F.col("i") % 2 == r, F.col("name"))) for r in (0, 1)]
        pairs = level.where("m > 1").groupBy("cls", "n", "m", F.floor(F.col("i") / 2).cast("int").alias("j")).agg(of[0].alias("l"), F.coalesce(of[1], F.lit(-1)).alias("r"))
        pairs = s.write(pairs.withColumn("at", F.monotonically_increasing_id()))
        named = s.write(pairs.groupBy("l", "r").agg(F.min("at").alias("name")))
        level = s.write(pairs.join(named, ["l", "r"]).select("cls", "n", F.ceil(F.col("m") / 2).cast("int").alias("m"), F.col("j").alias("i"), "name"))
        s.drop(pairs, named)

    identity = done[0]
    for d in done[1:]:
        identity = identity.unionByName(d)
    rows = local.where("kind = 2").select("id", "row", "cls", "sha")
    counted = rows.groupBy("cls").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("size"))
    classes = s.write(identity.join(counted, "cls"))
    groups = s.write(classes.groupBy("n", "name").agg(F.max("last").alias("keep"), F.sum("size").alias("group_size")))
    keeps = s.write(classes.select("cls", "n", "name").join(groups, ["n", "name"]).select("cls", "keep", "group_size"))
    s.drop(classes, groups)
    return rows.join(keeps, "cls").select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that ``exact_duplicates`` drops, with all its columns.

    Rows whose id no dropped row has stay as they are: while at most ``FEW`` ids are dropped these are broadcast and no text
    moves, beyond that one join by id moves it. Rows with such an id are told apart by their text; of rows that agree in
    both, one stays.
    """
    s = Scratch(df.sparkSession, "drop")
    judged = s.write(exact_duplicates(df, id_col, text_col).select(F.col(id_col).alias("__id"), "kept", F.col("text_sha256").alias("__sha")))
    touched = s.write(judged.where("not kept").select("__id").distinct())
    if touched.count() <= FEW:
        touched = F.broadcast(touched)
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    clean = df.join(touched, same, "left_anti")
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _UPPER.lower())
    unclear = df.join(touched, same, "left_semi").withColumn("__own", F.sha2(lower.cast("binary"), 256))
    stay = unclear.join(judged.where("kept"), same & (F.col("__own") == F.col("__sha")), "left_semi")
    return clean.unionByName(stay.dropDuplicates([id_col, "__own"]).drop("__own"))
