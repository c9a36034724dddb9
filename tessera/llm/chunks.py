"""Chunks of whole documents, and dictionaries exchanged between chunks and hash buckets.

Operators that look something up for every word or byte of a corpus would make too many rows for a shuffle. Here a
chunk (whole documents, about ``CHUNK`` bytes of text) sends each bucket one row with the distinct keys it has there,
sorted and gap-coded; the bucket answers each chunk with one row of values in the same order. A key that every document
holds costs one entry a chunk, so no key is hot, and neither side holds more than a chunk or a bucket. Both numbers
follow the input without a cap; there are never more rows than keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, partitions

CHUNK = 4 << 20
#: Bytes of text for each bucket.
BUCKET = 16 << 20
#: So many chunks (or buckets) have those sizes; beyond, they grow with the input up to ``GROWN`` times.
USUAL = 1 << 13
GROWN = 8
#: Cuts that may be broadcast, 40 bytes each.
MOST_CUTS = 1_000_000


@dataclass(frozen=True)
class Plan:
    df: DataFrame
    bits: int  # log2 of the number of buckets
    place: Callable[[DataFrame], DataFrame]  # adds the chunk to rows with the columns id and text
    total: int  # bytes of text
    ranges: int = 0  # chunks below this number ascend with the id
    size: int = 0  # bytes that a chunk is meant to have

    @property
    def table(self) -> DataFrame:
        """chunk, id, text (and other columns)"""
        return self.deal(self.df)

    def deal(self, df: DataFrame) -> DataFrame:
        """``df`` with the chunk of each row; it has the columns id and text, and may have others."""
        return self.place(df)


def _sized(total: int, unit: int, grown: int) -> int:
    return -(-total // min(grown * unit, max(unit, total // USUAL)))


def plan_chunks(df: DataFrame, chunk: int = CHUNK, grown: int = GROWN) -> Plan:
    """Deals the rows of ``df`` (id, text, ...) out to chunks by a hash of id and text: null and repeated ids are split
    like any others, and rows that agree in both share a chunk."""
    total, rows = df.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = total or 0
    n = min(max(2 * partitions(df.sparkSession), _sized(total, chunk, grown)), max(1, rows))
    bits = max(4, int(_sized(total, BUCKET, grown)).bit_length())
    return Plan(df, bits, lambda rows: rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")), total)


def plan_ranges(s: Scratch, df: DataFrame, chunk: int = CHUNK, grown: int = GROWN) -> Plan:
    """Cuts the rows of ``df`` (id, text; ids numbers) into chunks that ascend with the id, by prefix sums of their bytes.

    A chunk has about ``chunk`` bytes, or else one id. The cuts, two numbers a chunk, are broadcast up to ``MOST_CUTS`` of
    them and joined beyond. Rows without an id are dealt out by a hash of the text to chunks from number ``ranges`` on.
    """
    from tessera.llm.mixing import prefix_sums

    sizes = s.write(df.groupBy("id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes")))
    known, unknown = sizes.where("id is not null"), sizes.where("id is null")
    total, without = (x.agg(F.sum("bytes")).first()[0] or 0 for x in (known, unknown))
    size = max(1, -(-(total + without) // max(2 * partitions(df.sparkSession), _sized(total + without, chunk, grown))))
    placed = prefix_sums(s, known.withColumn("__all", F.lit(0)), "__all", [F.col("id")], "bytes", "before")
    most = sizes.agg(F.max("id")).first()[0]
    cuts = sorted(r["id"] for r in placed.groupBy(F.floor(F.col("before") / size)).agg(F.min("id").alias("id")).select("id").collect())
    kind = df.schema["id"].dataType.simpleString()
    ranges = s.write(df.sparkSession.createDataFrame(list(zip(cuts, [*cuts[1:], None], range(len(cuts)), strict=False)), f"low {kind}, end {kind}, chunk int"))
    # cuts meet ids in cells of equal width, so that the join has a key; a cell holds the cuts whose ranges touch it
    width = max(1.0, (float(most) - float(cuts[0])) / len(cuts)) if cuts else 1.0
    cell = lambda c: F.floor(c.cast("double") / F.lit(width))
    ranges = ranges.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.coalesce("end", F.lit(most).cast(kind))))))
    after = len(cuts) + F.pmod(F.xxhash64("text"), F.lit(max(1, -(-without // size))))
    hinted = F.broadcast(ranges) if len(cuts) <= MOST_CUTS else ranges
    own = [hinted["cell"] == cell(F.col("id")), hinted["low"] <= F.col("id"), hinted["end"].isNull() | (F.col("id") < hinted["end"])]

    def place(rows: DataFrame) -> DataFrame:
        found = rows.join(hinted, own[0] & own[1] & own[2], "left")
        return found.select(*rows.columns, F.coalesce(hinted["chunk"], after).cast("int").alias("chunk"))

    return Plan(df, max(4, int(_sized(total + without, BUCKET, grown)).bit_length()), place, total + without, len(cuts), size)


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that doesn't depend on how they arrived: by id (null last), then text."""
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_end"))


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as gaps of the fewest whole bytes that hold the largest."""
    gaps = values.copy()
    gaps[1:] -= values[:-1]
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width, body = blob[0], np.frombuffer(blob, np.uint8, offset=1)
    wide = np.zeros((len(body) // width, 8), np.uint8)
    wide[:, :width] = body.reshape(-1, width)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest whole bytes that hold the largest."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    width, body = blob[0], np.frombuffer(blob, np.uint8, offset=1)
    wide = np.zeros((len(body) // width, 8), np.uint8)
    wide[:, :width] = body.reshape(-1, width)
    return wide.reshape(-1).view("<i8")


def bucket_edges(sorted_keys: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    """Where each bucket's keys begin, the end included; a bucket is the top bits of a key of ``width`` bits."""
    tops = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)
    return np.concatenate(([0], np.searchsorted(sorted_keys, tops), [len(sorted_keys)]))


def by_bucket(replies: pa.Table) -> list[dict]:
    """A chunk's replies in the order of its keys."""
    return sorted(replies.to_pylist(), key=lambda r: r["bucket"])
