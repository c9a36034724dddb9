"""Searches over the embeddings, by every strategy; the SQL is the exhaustive definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DistanceType, Layout, QueryType, SearchConfig
from tessera.operators import search
from tessera.plans import index, planner
from tessera.queries.tables import in_blocks, queries, rounded, series, table

K, R, BAND, DTW_BAND = 10, 1.55, 6, 6
#: The radius keeps about a tenth of the pairs.
DTW_K, DTW_R = 5, 0.5
WINDOW = 100
LAYOUT = Layout(segments=16, bits=4, leaf_size=50)
TOP = SearchConfig(k=K)
WITHIN = SearchConfig(r=R, type=QueryType.RANGE)
TOP_DTW = SearchConfig(k=DTW_K, distance=DistanceType.DTW, band=DTW_BAND)
WITHIN_DTW = SearchConfig(r=DTW_R, type=QueryType.RANGE, distance=DistanceType.DTW, band=DTW_BAND)


def _l2() -> str:
    return """e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
q AS (SELECT id AS qid, v AS w, i AS j FROM e WHERE id % 50 = 0),
d AS (SELECT qid, id, sum((w - v) * (w - v)) AS dist FROM q JOIN e ON i = j GROUP BY qid, id)"""


TOP_SQL = f"""WITH {_l2()}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)
SELECT qid, rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {K}"""
RANGE_SQL = f"WITH {_l2()} SELECT qid, id, round(dist, 6) AS dist FROM d WHERE dist <= {R}"
RECENT_SQL = f"""WITH {_l2()}, w AS (SELECT * FROM d WHERE id > (SELECT max(vec_id) FROM embeddings) - {WINDOW}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM w) SELECT qid, rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {K}"""
SELF_SQL = f"""WITH {_l2()}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d WHERE qid <> id)
SELECT qid, rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {K}"""
COUNT_SQL = f"WITH {_l2()} SELECT qid, count(*) FILTER (WHERE dist <= {R}) AS hits FROM d GROUP BY qid"
VOTE_SQL = f"""WITH {_l2()}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d WHERE qid <> id),
v AS (SELECT qid, label, count(*) AS votes FROM r JOIN embeddings ON vec_id = id WHERE rank <= {K} GROUP BY qid, label)
SELECT qid, CAST(label AS BIGINT) AS label, votes FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS n FROM v) WHERE n = 1"""
RAGGED_SQL = f"""WITH {_l2()}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)
SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids, max(rank) AS n FROM r WHERE rank <= {K} GROUP BY qid"""
#: Dynamic programming by anti-diagonals: a cell needs the two diagonals before its own.
DTW_SQL = f"""WITH RECURSIVE p AS (SELECT q.vec_id AS qid, e.vec_id AS id, q.embedding AS a, e.embedding AS b, len(q.embedding) AS n FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
t(qid, id, a, b, n, k, now, before) AS (
  SELECT qid, id, a, b, n, 2, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 1 THEN (a[1]::DOUBLE - b[1]::DOUBLE) * (a[1]::DOUBLE - b[1]::DOUBLE) ELSE 'infinity'::DOUBLE END),
         list_transform(range(0, n + 1), lambda i: 'infinity'::DOUBLE) FROM p
  UNION ALL
  SELECT qid, id, a, b, n, k + 1,
         list_transform(range(0, n + 1), lambda i: CASE WHEN i < 1 OR k + 1 - i < 1 OR k + 1 - i > n OR abs(2 * i - k - 1) > {DTW_BAND} THEN 'infinity'::DOUBLE
           ELSE (a[i]::DOUBLE - b[k + 1 - i]::DOUBLE) * (a[i]::DOUBLE - b[k + 1 - i]::DOUBLE) + least(now[i], now[i + 1], before[i]) END), now
  FROM t WHERE k < 2 * n),
d AS (SELECT qid, id, now[n + 1] AS dist FROM t WHERE k = 2 * n)"""
DTW_TOP_SQL = DTW_SQL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)
SELECT qid, rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {DTW_K}"""
DTW_RANGE_SQL = DTW_SQL + f" SELECT qid, id, round(dist, 6) AS dist FROM d WHERE dist <= {DTW_R}"


def _by(strategy: str, config: SearchConfig):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        built = index.build(series(spark, sf_dir), strategy, LAYOUT)
        return rounded(in_blocks(queries(spark, sf_dir), lambda q: index.search(built, q, config)))

    return run


def _scan(config: SearchConfig):
    return lambda spark, d: rounded(in_blocks(queries(spark, d), lambda q: search.search(series(spark, d), q, config)))


def _native(config: SearchConfig):
    return lambda spark, d: rounded(in_blocks(queries(spark, d), lambda q: search.search_native(series(spark, d), q, config)))


def recent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(in_blocks(queries(spark, d), lambda q: search.recent_top_k(series(spark, d), q, K, WINDOW)))


def without_self(spark: SparkSession, d: str) -> DataFrame:
    return in_blocks(queries(spark, d), lambda q: search.without_self(series(spark, d), q, TOP))


def hit_counts(spark: SparkSession, d: str) -> DataFrame:
    q = queries(spark, d)
    hits = in_blocks(q, lambda b: search.search(series(spark, d), b, WITHIN)).groupBy("qid").agg(F.count("*").alias("hits"))
    return q.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"))


def label_vote(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    near = without_self(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    votes = near.join(labels, "id").groupBy("qid", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("qid").orderBy(F.desc("votes"), "label")
    return votes.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def ragged(spark: SparkSession, d: str) -> DataFrame:
    r = search.ragged(in_blocks(queries(spark, d), lambda q: search.search(series(spark, d), q, TOP)))
    return r.select("qid", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


def planned(spark: SparkSession, d: str) -> DataFrame:
    return rounded(in_blocks(queries(spark, d), lambda q: planner.search(series(spark, d), q, TOP, LAYOUT)))


QUERIES = {
    "l2_topk": (_scan(TOP), TOP_SQL), "l2_topk_native": (_native(TOP), TOP_SQL), "l2_topk_planned": (planned, TOP_SQL), "l2_range": (_scan(WITHIN), RANGE_SQL), "l2_range_native": (_native(WITHIN), RANGE_SQL),
    **{f"l2_topk_{s}": (_by(s, TOP), TOP_SQL) for s in index.STRATEGIES}, **{f"l2_range_{s}": (_by(s, WITHIN), RANGE_SQL) for s in index.STRATEGIES},
    "dtw_topk": (_scan(TOP_DTW), DTW_TOP_SQL), "dtw_range": (_scan(WITHIN_DTW), DTW_RANGE_SQL),
    **{f"dtw_topk_{s}": (_by(s, TOP_DTW), DTW_TOP_SQL) for s in ("sax", "isax", "zorder", "multiary")}, "dtw_range_isax": (_by("isax", WITHIN_DTW), DTW_RANGE_SQL),
    "recent_topk": (recent, RECENT_SQL), "knn_without_self": (lambda s, d: rounded(without_self(s, d)), SELF_SQL), "range_hit_counts": (hit_counts, COUNT_SQL),
    "knn_label_vote": (label_vote, VOTE_SQL), "topk_ragged": (ragged, RAGGED_SQL),
}
