"""A corpus pipeline of five stages over ``documents``; each works on all that the stage before kept.

1. language ID: documents that it rejects go; 2. exact dedup: one row of equal texts stays; 3. n-gram Jaccard join over
five-word shingles at 0.8: one document of each group stays; 4. mixing: documents repeat or go as their source's budget
says; 5. BPE: ids and decoded text as digests. Stages 1 to 4 return the columns of the table that they get, whichever
these are besides ``doc_id``, ``text``, ``lang`` and ``source``. An empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, dedup, jaccard, langid, mixing
from tessera.llm._shared import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the input outside fold 2; drops what is far from all languages."""
    model = langid.fit(docs.where(langid.fold("doc_id", 4) != 2))
    keep = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return langid.predict(docs, model, keep).where("not rejected").select(*(F.col(v).alias(k) for k, v in keep.items()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays: that of the largest id. Null and empty texts are equal."""
    return dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each connected group of near copies stays: that of the least id. Texts without a word all stay."""
    return jaccard.near_duplicates(docs, k=5, percent=80, keep_all=True).where("kept").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it, the last time cut to the words that fill the budget."""
    return mixing.apply_mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row; a null text counts as empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Language ID is learned, and the tokenizer's merges aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = s.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
