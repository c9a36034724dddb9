"""Token counts by section: offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' spans are then interval-joined to the spans of its sections (lines,
or the fields that were put together to make it), both sorted, by binary search. A token whose characters lie in two
sections or more goes to one of them by ``rule``: ``start`` (where its first character is), ``end`` (its last), or
``most`` (the most of its characters; of equal sections the earliest). So the sections' counts add up to the document's.

A null or empty text has one section without tokens. Only the named columns are read. Rows are independent: repeated
ones give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import as_buffer, pieces
from tessera.llm.bpe import Encoder, encoder

RULES = ("start", "end", "most")


def owners(tokens: np.ndarray, sections: np.ndarray, characters: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses. ``tokens`` and ``sections``: ascending byte positions where each
    begins, the end of the last token appended; ``characters``: the character that each byte belongs to."""
    begin, last = tokens[:-1], tokens[1:] - 1
    character_start = np.searchsorted(characters, characters[begin], side="left") if len(begin) else begin
    first = np.searchsorted(sections, character_start, side="right") - 1
    final = np.searchsorted(sections, last, side="right") - 1
    crossing = first != final
    if rule == "start":
        return first, crossing
    if rule == "end":
        return final, crossing
    own = first.copy()
    for i in np.flatnonzero(crossing):
        where = np.searchsorted(sections, np.searchsorted(characters, np.arange(characters[begin[i]], characters[last[i]] + 1)), side="right") - 1
        which, n = np.unique(where, return_counts=True)
        own[i] = which[np.argmax(n)]
    return own, crossing


def _attribute(bpe: Encoder, data: np.ndarray, offsets: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, crossing tokens, characters) of each section of a run of texts."""
    raw = data.tobytes()
    ids, _ = bpe.encode([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    tokens = np.concatenate(([0], np.cumsum(bpe.lengths[ids])))
    if tokens[-1] != len(data):
        raise ValueError("the tokens don't spell the texts")
    leads = (data & 0xC0) != 0x80
    own, crossing = owners(tokens, sections, np.cumsum(leads) - 1, rule)
    n = len(sections)
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n), np.diff(np.append(np.concatenate(([0], np.cumsum(leads)))[sections], leads.sum()))


def _rows(id_column: pa.Array, each: np.ndarray, n: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    which = np.repeat(np.arange(len(each)), each)
    section = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    return pa.RecordBatch.from_arrays([id_column.take(pa.array(which)), pa.array(section, pa.int64()), *(pa.array(x, pa.int64()) for x in n)], ["id", "section", "n_tokens", "n_crossing", "n_chars"])


_OUT = "id {}, section long, n_tokens long, n_crossing long, n_chars long"


def count_by_line(df: DataFrame, tokenizer: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of each row's text: id, section (from 0), n_tokens, n_crossing, n_chars.

    A line feed ends its line and belongs to it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for a, b, d, o in pieces(*as_buffer(batch.column(1)), 2 << 20):
                after = np.flatnonzero(d == 0x0A) + 1
                inner = np.setdiff1d(after, o)
                sections = np.sort(np.concatenate((o[:-1], inner)), kind="stable")
                each = 1 + np.bincount(np.searchsorted(o, inner, side="right") - 1, minlength=b - a)
                yield _rows(batch.column(0).slice(a, b - a), each, _attribute(bpe, d, o, sections, rule))

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _OUT.format(kind)).withColumnRenamed("id", id_col)


def count_by_field(df: DataFrame, tokenizer: str, fields: Sequence[str], rule: str = "start", id_col: str = "doc_id") -> DataFrame:
    """A row for each field of each row: as ``count_by_line``, for the document that the fields make one after the other.

    ``section`` is the field's place in ``fields``; a null field is empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            data, offsets = as_buffer(batch.column(1))
            lengths = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, len(fields)).astype(np.int64)
            for a, b, d, o in pieces(data, offsets, 2 << 20):
                sections = np.concatenate(([0], np.cumsum(lengths[a:b].ravel())))[:-1]
                yield _rows(batch.column(0).slice(a, b - a), np.full(b - a, len(fields)), _attribute(bpe, d, o, sections, rule))

    kind = df.schema[id_col].dataType.simpleString()
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    made = df.select(F.col(id_col).alias("id"), F.concat(*values).alias("text"), F.array(*(F.octet_length(v) for v in values)).alias("lengths"))
    return made.mapInArrow(run, _OUT.format(kind)).withColumnRenamed("id", id_col)
