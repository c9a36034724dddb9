"""The registered queries of the subpackage: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import attribution, bpe, ctw, dedup, imi, jaccard, langid, mixing, substring, urlfilter
from tessera.llm._shared import documents

TOKENIZER = "byte_bpe_50k.json"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), k=3, percent=90)


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0
    return ctw.score_documents(documents(spark, sf_dir), held)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.count_by_line(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), "start")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir), k=13)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_exact_dedup, op2_url_filter, op3_mixing, op4_ann, op5_language_id, op6_jaccard_join, op7_ctw, op8_token_counts, op9_bpe, op10_substring_dedup, pipeline]
    return {q.__name__: q for q in every}


OP1_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""

#: Water filling in closed form: with sources by 3 * size / weight, the full ones are a prefix.
OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS i FROM w),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
l AS (SELECT level FROM c WHERE 3.0 * source_size > weight * level ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, least(3.0 * source_size, weight * coalesce((SELECT level FROM l), 0.0))::DOUBLE AS target FROM w),
p AS (SELECT sized.doc_id, sized.source, sized.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             CAST(coalesce(sum(sized.size) OVER (PARTITION BY sized.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
            + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE budget END - before)) AS BIGINT) AS taken
FROM p
"""

OP10_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
n AS (SELECT doc_id, pos, concat_ws(' ', word, {", ".join(f"lead(word, {i}) OVER o" for i in range(1, 13))}) AS g, lead(word, 12) OVER o AS final
      FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, pos, g FROM n WHERE final IS NOT NULL),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
c AS (SELECT DISTINCT x.doc_id, pos + k AS pos FROM x JOIN f ON x.g = f.g, range(0, 13) t(k) WHERE first < x.doc_id),
r AS (SELECT a.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY a.pos) FILTER (WHERE c.pos IS NULL) AS kept
      FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.pos = c.pos GROUP BY a.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_mixing": OP3_SQL, "op10_substring_dedup": OP10_SQL}
