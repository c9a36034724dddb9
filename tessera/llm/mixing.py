"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every row gets a key that is random but fixed by its id. Rows are range-partitioned by (source, key), so a source of any
size spreads over many tasks; each partition's sums by source are a table of at most partitions + sources rows, whose
running sums are the partitions' offsets. A source gives all its rows as often as its budget allows, and the last,
partial epoch ends at the exact word that fills the budget, which may be inside a row.

A null text has size 0; a null source is a source of its own, ordered last. A source without words has target 0. Rows
that repeat an id take their shares one after the other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._shared import Scratch, partitions
from tessera.llm._text import as_buffer, pieces, words


def word_counts(df: DataFrame, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """Columns of ``df`` under new names, and ``size``: the words of each whole text."""
    kinds = ", ".join(f"{new} {df.schema[old].dataType.simpleString()}" for old, new in keep.items())
    at = [*keep].index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_buffer(batch.column(at))
            sizes = [words(d, o)[2] for _, _, d, o in pieces(data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], [*keep.values(), "size"])

    return df.select(*(F.col(o).alias(n) for o, n in keep.items()), *([F.col(text_col).alias("__text")] if at == len(keep) else [])).mapInArrow(run, f"{kinds}, size long")


def prefix_sums(s: Scratch, df: DataFrame, group: str, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of ``group`` that come before in ``order``."""
    n = partitions(df.sparkSession)
    spread = s.write(df.repartitionByRange(n, F.col(group), *order).withColumn("__part", F.spark_partition_id()))
    own = spread.groupBy("__part", group).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("__before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(offsets, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn(out, F.col("__before") + F.col("__offset")).drop("__part", "__p", "__g", "__offset", "__before")


def source_targets(s: Scratch, sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size) -> also target: ``share`` of all sizes by weight, at most ``most`` times a source's size.

    Weights repeat over the sources in code-point order, null last. What a full source can't take is shared anew among
    the others by weight, until none is above.
    """
    ranked = prefix_sums(s, sizes.withColumns({"__one": F.lit(1).cast("long"), "__all": F.lit(0)}), "__all", [F.col("source").isNull(), F.col("source")], "__one", "__rank")
    table = F.array(*(F.lit(float(w)) for w in weights))
    ranked = s.write(ranked.select("source", "source_size", table[(F.col("__rank") % len(weights)).cast("int")].alias("weight")))
    total = float((ranked.agg(F.sum("source_size")).first()[0] or 0) * share)
    level, full = 0.0, -1
    while True:
        is_full = F.col("source_size") * most <= F.col("weight") * F.lit(level)
        caps, rest, now = ranked.agg(F.sum(F.when(is_full, F.col("source_size") * most)), F.sum(F.when(~is_full, F.col("weight"))), F.sum(is_full.cast("long"))).first()
        if now == full or not rest:
            break
        level, full = (total - (caps or 0.0)) / rest, now
    return ranked.withColumn("target", F.least(F.col("source_size") * most, F.col("weight") * F.lit(level))).drop("weight")


def mix_sources(
    df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row for each row of ``df``: id, source, size, source_size, target, taken, all in words."""
    s = Scratch(df.sparkSession, "mixing")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = s.write(word_counts(df, {id_col: "id", source_col: "source"}, text_col).withColumn("key", key))
    targets = s.write(source_targets(s, sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    ordered = prefix_sums(s, sized, "source", [F.col("key"), F.col("id"), F.col("size")], "size", "before")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    t = targets.select(F.col("source").alias("__source"), "source_size", "target")
    out = ordered.join(t, F.col("source").eqNullSafe(F.col("__source")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``df`` once for each time that it is taken whole, and, where a source's budget ends
    inside it, once with its first words only, whose characters ``n_chars`` then counts. All columns of ``df``, in its types.

    Rows that share id, source and size are given their shares in any order.
    """
    taken = mix_sources(df, weights, share, most, seed, id_col, text_col, source_col)
    rank = F.row_number().over(Window.partitionBy(id_col, "source", "size").orderBy("taken"))
    shares = taken.select(F.col(id_col).alias("__id"), F.col("source").alias("__s"), F.col("size").alias("__n"), "taken", rank.alias("__r")).where("taken > 0")
    carried = {c: f"c{i}" for i, c in enumerate(df.columns)}
    counted = word_counts(df, carried, text_col)
    own_id, own_source, own_text = (F.col(carried[c]) for c in (id_col, source_col, text_col))
    ranked = counted.withColumn("__k", F.row_number().over(Window.partitionBy(own_id, own_source, "size").orderBy(own_text)))
    join = own_id.eqNullSafe(F.col("__id")) & own_source.eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__n")) & (F.col("__k") == F.col("__r"))
    mixed = ranked.join(shares, join).withColumn("__left", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))))
    part = F.least(F.col("size"), F.col("taken") - F.col("__left") * F.col("size"))
    cut = F.when(part < F.col("size"), first_words(own_text, part)).otherwise(own_text)
    values = {c: F.col(carried[c]) for c in df.columns} | {text_col: cut}
    if "n_chars" in values:
        values["n_chars"] = F.when(part < F.col("size"), F.length(cut).cast(df.schema["n_chars"].dataType)).otherwise(values["n_chars"])
    return mixed.select(*(v.alias(c) for c, v in values.items()))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    return F.array_join(F.slice(parts, 1, n.cast("int")), "")
