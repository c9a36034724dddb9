"""Transforms, summaries and bounds over the embeddings, in long form: one number a row."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Layout
from tessera.functions import columns, kernels
from tessera.operators import search
from tessera.operators.validate import as_queries
from tessera.plans import index
from tessera.queries.tables import in_blocks, queries, rounded, series, table

DIM, SEGMENTS, BITS, BAND = 64, 16, 4, 6
LENGTH = DIM // SEGMENTS
CUTS = [NormalDist().inv_cdf(j / 16) for j in range(1, 16)]
#: Fixed cuts for the embeddings' scale, so that symbols spread.
FINE = [c / 8 for c in CUTS]
COEFFICIENTS = 8

_E = "e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
_Z = f"{_E}, s AS (SELECT id, avg(v) AS m, stddev_pop(v) AS d FROM e GROUP BY id), z AS (SELECT e.id, i, CASE WHEN d > 0 THEN (v - m) / d ELSE 0 END AS v FROM e JOIN s ON e.id = s.id)"
_P = f"p AS (SELECT id, i // {LENGTH} AS i, avg(v) AS v FROM z GROUP BY ALL)"
_CUTS = "c AS (SELECT unnest([" + ", ".join(map(repr, CUTS)) + "]) AS cut)"
_FINE = "c AS (SELECT unnest([" + ", ".join(map(repr, FINE)) + "]) AS cut)"
_S = f"WITH {_Z}, {_P}, {_CUTS}, x AS (SELECT id, i, (SELECT count(*) FROM c WHERE cut < v) AS v FROM p)"


def _long(df: DataFrame, column: str = "v") -> DataFrame:
    return df.select("id", F.posexplode(column).alias("i", "v"))


def _z(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).select("id", columns.z_normalize(F.col("series")).alias("z"))


def _paa(spark: SparkSession, d: str) -> DataFrame:
    return _z(spark, d).select("id", columns.paa(F.col("z"), DIM, SEGMENTS).alias("p"))


def _sax(spark: SparkSession, d: str) -> DataFrame:
    return _paa(spark, d).select("id", columns.symbolize(F.col("p"), columns.array_of(CUTS)).alias("w"))


def znorm(spark, d):
    return rounded(_long(_z(spark, d), "z"))


def paa(spark, d):
    return rounded(_long(_paa(spark, d), "p"))


def sax_gauss(spark, d):
    return rounded(_long(_sax(spark, d), "w"))


def isax_two_bits(spark, d):
    return rounded(_long(_sax(spark, d).select("id", F.transform("w", lambda x: columns.symbol_at_bits(x, 2, BITS)).alias("w")), "w"))


def root_mask_histogram(spark, d):
    return _sax(spark, d).groupBy(columns.root_mask(F.col("w"), BITS).alias("mask")).agg(F.count("*").alias("n"))


def z_keys(spark, d):
    return _sax(spark, d).select("id", F.lower(columns.z_key_hex(F.col("w"), SEGMENTS, BITS)).alias("key"))


Z_KEY_SQL = f"""{_S}, n AS (SELECT id, plane, i // 4 AS q, sum(((v >> ({BITS - 1} - plane)) & 1) << (3 - i % 4)) AS nibble FROM x, range(0, {BITS}) t(plane) GROUP BY ALL)
SELECT id, string_agg(substr('0123456789abcdef', CAST(nibble AS INTEGER) + 1, 1), '' ORDER BY plane, q) AS key FROM n GROUP BY id"""


def regions(spark, d):
    """Region and midpoint of each symbol of the first segments, at two bits."""
    w = _sax(spark, d).select("id", F.posexplode("w").alias("i", "s"))
    lo, hi = columns.region(columns.symbol_at_bits(F.col("s"), 2, BITS), 2, CUTS)
    return rounded(w.select("id", "i", F.coalesce(lo, F.lit(-9.0)).alias("low"), F.coalesce(hi, F.lit(9.0)).alias("high"), columns.midpoint(F.col("s"), CUTS).alias("middle")))


_LOWS, _HIGHS = [2 * CUTS[0] - CUTS[1], *CUTS], [*CUTS, 2 * CUTS[-1] - CUTS[-2]]
REGION_SQL = f"""{_S} SELECT id, i, round(CASE WHEN v // 4 = 0 THEN -9 ELSE [{", ".join(repr(CUTS[j]) for j in (3, 7, 11))}][v // 4] END, 6) AS low,
round(CASE WHEN v // 4 = 3 THEN 9 ELSE [{", ".join(repr(CUTS[j]) for j in (3, 7, 11))}][v // 4 + 1] END, 6) AS high, round([{", ".join(repr((a + b) / 2) for a, b in zip(_LOWS, _HIGHS, strict=True))}][v + 1], 6) AS middle
FROM x"""


def equidepth_breakpoints(spark, d):
    values = _long(_paa(spark, d), "p")
    cuts = F.percentile("v", F.array(*(F.lit(j / 16) for j in range(1, 16))))
    return rounded(values.agg(cuts.alias("c")).select(F.posexplode("c").alias("j", "cut")))


EQUI_SQL = f"WITH {_Z}, {_P}, q AS (SELECT quantile_cont(v, [{', '.join(repr(j / 16) for j in range(1, 16))}]) AS c FROM p) SELECT generate_subscripts(c, 1) - 1 AS j, round(unnest(c), 6) AS cut FROM q"


def sax_equidepth(spark, d):
    p = _long(_paa(spark, d), "p")
    cuts = p.agg(F.percentile("v", F.array(*(F.lit(j / 16) for j in range(1, 16)))).alias("c"))
    words = _paa(spark, d).crossJoin(F.broadcast(cuts)).select("id", columns.symbolize(F.col("p"), F.col("c")).alias("w"))  # one row of 15 numbers
    return _long(words, "w").groupBy("i", F.col("v").cast("long").alias("symbol")).agg(F.count("*").alias("n")).withColumn("i", F.col("i").cast("long"))


EQUI_SAX_SQL = f"""WITH {_Z}, {_P}, q AS (SELECT unnest(quantile_cont(v, [{", ".join(repr(j / 16) for j in range(1, 16))}])) AS cut FROM p),
x AS (SELECT i, (SELECT count(*) FROM q WHERE cut < v) AS symbol FROM p) SELECT i, symbol, count(*) AS n FROM x GROUP BY i, symbol"""


def envelopes(spark, d):
    up, lo = columns.envelope(F.col("series"), BAND)
    e = series(spark, d).select("id", up.alias("u"), lo.alias("l"))
    return rounded(e.select("id", F.posexplode(F.arrays_zip("u", "l")).alias("i", "x")).select("id", "i", F.col("x.u").alias("upper"), F.col("x.l").alias("lower")))


ENVELOPE_SQL = f"""WITH {_E} SELECT id, i, round(max(v) OVER w, 6) AS upper, round(min(v) OVER w, 6) AS lower FROM e
WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN {BAND} PRECEDING AND {BAND} FOLLOWING)"""


def fourier(spark, d):
    return rounded(_long(series(spark, d).select("id", columns.fourier(F.col("series"), DIM, COEFFICIENTS).alias("f")), "f"))


_F = f"f AS (SELECT id, j AS i, sum(v * CASE WHEN j % 2 = 0 THEN cos(2 * pi() * (j // 2) * e.i / {DIM}) ELSE sin(2 * pi() * (j // 2) * e.i / {DIM}) END) * sqrt(2.0 / {DIM}) AS v FROM e, range(0, {COEFFICIENTS}) t(j) GROUP BY id, j)"
FOURIER_SQL = f"WITH {_E}, {_F} SELECT id, i, round(v, 6) + 0.0 AS v FROM f"


def _features(spark, d):
    return _long(series(spark, d).select("id", columns.fourier(F.col("series"), DIM, COEFFICIENTS).alias("f")), "f").where("i <> 1")


def bins_equal_width(spark, d):
    """Cuts of each coefficient (not the mean's imaginary part, which is 0) at equal widths."""
    ends = _features(spark, d).groupBy("i").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return rounded(ends.select("i", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("j"), "a", "b").select("i", "j", (F.col("a") + F.col("j") * (F.col("b") - F.col("a")) / 8).alias("cut")))


WIDTH_SQL = f"WITH {_E}, {_F}, m AS (SELECT i, min(v) AS a, max(v) AS b FROM f WHERE i <> 1 GROUP BY i) SELECT i, j, round(a + j * (b - a) / 8, 6) AS cut FROM m, range(1, 8) t(j)"


def bins_equal_depth(spark, d):
    """The value at place floor(j * n / 8) of each sorted coefficient."""
    n = series(spark, d).count()
    cuts = F.percentile("v", F.array(*(F.lit(((j * n) // 8) / (n - 1)) for j in range(1, 8))))
    return rounded(_features(spark, d).groupBy("i").agg(cuts.alias("c")).select("i", F.posexplode("c").alias("j", "cut")).withColumn("j", F.col("j") + 1))


DEPTH_SQL = f"""WITH {_E}, {_F}, r AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY i) AS n FROM f WHERE i <> 1)
SELECT i, j, round(v, 6) AS cut FROM r, range(1, 8) t(j) WHERE place = (j * n) // 8"""


def sfa_words(spark, d):
    """Symbols under the equal-width cuts; intervals are [cut, next cut)."""
    f = _features(spark, d)
    ends = f.groupBy("i").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda j: F.round(F.col("a") + j * (F.col("b") - F.col("a")) / 8, 9))
    return f.join(ends, "i").select(F.col("id"), F.col("i").cast("long").alias("i"), columns.quantize(F.round("v", 9), cuts).cast("long").alias("v"))


SFA_SQL = f"WITH {_E}, {_F}, m AS (SELECT i, min(v) AS a, max(v) AS b FROM f WHERE i <> 1 GROUP BY i) SELECT id, i, (SELECT count(*) FROM range(1, 8) t(j) WHERE round(a + j * (b - a) / 8, 9) <= round(v, 9)) AS v FROM f JOIN m USING (i)"


def sketches(spark, d):
    s = series(spark, d).select("id", columns.sketch(F.col("series"), DIM, 8).alias("s"))
    return rounded(s.select("id", F.posexplode("s").alias("i", "x")).select("id", "i", F.col("x.mean").alias("mean"), F.col("x.deviation").alias("deviation")))


_K = "k AS (SELECT id, i // 8 AS i, avg(v) AS mean, stddev_pop(v) AS deviation FROM e GROUP BY ALL)"
SKETCH_SQL = f"WITH {_E}, {_K} SELECT id, i, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM k"


def node_sketches(spark, d):
    """Boxes of sketches by label, as the nodes of a tree would have."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("node"))
    s = series(spark, d).select("id", columns.sketch(F.col("series"), DIM, 8).alias("s")).select("id", F.posexplode("s").alias("i", "x")).join(labels, "id")
    return rounded(s.groupBy("node", "i").agg(F.max("x.mean").alias("mean_max"), F.min("x.mean").alias("mean_min"), F.max("x.deviation").alias("dev_max"), F.min("x.deviation").alias("dev_min")))


NODE_SQL = f"""WITH {_E}, {_K} SELECT CAST(label AS BIGINT) AS node, i, round(max(mean), 6) AS mean_max, round(min(mean), 6) AS mean_min, round(max(deviation), 6) AS dev_max, round(min(deviation), 6) AS dev_min
FROM k JOIN embeddings ON vec_id = id GROUP BY label, i"""


def _keogh(q: np.ndarray):
    upper, lower = kernels.envelope(q, BAND)

    def bound(x: np.ndarray, some: slice) -> np.ndarray:
        out = np.empty((len(upper[some]), len(x)))
        for a in range(0, len(x), 512):
            for i, (u, w) in enumerate(zip(upper[some], lower[some], strict=True)):
                out[i, a : a + 512] = kernels.lb_keogh(u, w, x[a : a + 512])
        return out

    return bound


def keogh_pairs(spark, d):
    s = series(spark, d)
    return in_blocks(queries(spark, d), lambda b: search.all_pairs(s, *as_queries(b), _keogh))


KEOGH_SQL = f"""WITH {_E}, v AS (SELECT id, i, max(v) OVER w AS u, min(v) OVER w AS l FROM e WHERE id % 50 = 0 WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN {BAND} PRECEDING AND {BAND} FOLLOWING))
SELECT v.id AS qid, e.id, round(sum(greatest(0, e.v - u) * greatest(0, e.v - u) + greatest(0, l - e.v) * greatest(0, l - e.v)), 6) AS bound FROM e JOIN v ON e.i = v.i GROUP BY ALL"""


def _symbols(q: np.ndarray):
    means, cuts = kernels.paa(q, SEGMENTS), np.array(FINE)
    tables = kernels.sax_tables(means, means, cuts, np.full(SEGMENTS, float(LENGTH)))

    def bound(x: np.ndarray, some: slice) -> np.ndarray:
        words, part = kernels.symbolize(kernels.paa(x, SEGMENTS), cuts), np.ascontiguousarray(tables[:, :, some])
        return sum(part[j].take(words[:, j], axis=0) for j in range(SEGMENTS)).T

    return bound


def sax_bounds(spark, d):
    s = series(spark, d)
    return in_blocks(queries(spark, d), lambda b: search.all_pairs(s, *as_queries(b), _symbols))


SAX_BOUND_SQL = f"""WITH {_E}, p AS (SELECT id, i // {LENGTH} AS i, avg(v) AS v FROM e GROUP BY ALL), {_FINE}, k AS (SELECT [{", ".join(map(repr, FINE))}] AS cuts),
x AS (SELECT id, i, (SELECT count(*) FROM c WHERE cut < v) AS s FROM p)
SELECT p.id AS qid, x.id, round({LENGTH} * sum(pow(greatest(0, coalesce(CASE WHEN s > 0 THEN cuts[s] END - v, 0), coalesce(v - CASE WHEN s < 15 THEN cuts[s + 1] END, 0)), 2)), 6) AS bound
FROM p JOIN x ON p.i = x.i, k WHERE p.id % 50 = 0 GROUP BY ALL"""


def bound_violations(spark, d):
    """Pairs whose symbol bound is above their distance: none."""
    s = series(spark, d)
    counts = in_blocks(queries(spark, d), lambda b: search.violations(s, as_queries(b)[1], _symbols))
    return counts.agg(F.sum("violations").alias("violations"), F.sum("pairs").alias("pairs"))


VIOLATION_SQL = "SELECT CAST(0 AS BIGINT) AS violations, CAST(count(*) * count(*) FILTER (WHERE vec_id % 50 = 0) AS BIGINT) AS pairs FROM embeddings"


def index_statistics(spark, d):
    """Nodes cover all rows once, by strategy."""
    rows = []
    for s in index.STRATEGIES:
        i = index.build(series(spark, d), s, Layout(segments=16, bits=4, leaf_size=50))
        rows.append((s, int(i.nodes["size"].sum()), bool((i.nodes["low"] <= i.nodes["high"]).all())))
        i.rows.unpersist()
    return spark.createDataFrame(rows, "strategy string, n long, boxed boolean")


STATISTICS_SQL = "SELECT s AS strategy, n, true AS boxed FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in index.STRATEGIES) + "]) AS s), (SELECT count(*) AS n FROM embeddings)"

QUERIES_SQL = {
    "znorm": (znorm, f"WITH {_Z} SELECT id, i, round(v, 6) + 0.0 AS v FROM z"),
    "paa": (paa, f"WITH {_Z}, {_P} SELECT id, i, round(v, 6) + 0.0 AS v FROM p"),
    "sax_gauss": (sax_gauss, f"{_S} SELECT id, i, v FROM x"),
    "isax_two_bits": (isax_two_bits, f"{_S} SELECT id, i, v // 4 AS v FROM x"),
    "root_mask_hist": (root_mask_histogram, f"{_S}, m AS (SELECT id, CAST(sum((v >> {BITS - 1}) << ({SEGMENTS - 1} - i)) AS BIGINT) AS mask FROM x GROUP BY id) SELECT mask, count(*) AS n FROM m GROUP BY mask"),
    "z_key": (z_keys, Z_KEY_SQL), "symbol_regions": (regions, REGION_SQL), "equidepth_breakpoints": (equidepth_breakpoints, EQUI_SQL), "sax_equidepth": (sax_equidepth, EQUI_SAX_SQL),
    "envelope": (envelopes, ENVELOPE_SQL), "dft_features": (fourier, FOURIER_SQL), "mcb_equiwidth": (bins_equal_width, WIDTH_SQL), "mcb_equidepth": (bins_equal_depth, DEPTH_SQL), "sfa_words": (sfa_words, SFA_SQL),
    "eapca_sketch": (sketches, SKETCH_SQL), "eapca_node_sketch": (node_sketches, NODE_SQL), "lb_keogh_pairs": (keogh_pairs, KEOGH_SQL), "lb_sax_pairs": (sax_bounds, SAX_BOUND_SQL), "lb_violations": (bound_violations, VIOLATION_SQL),
    "index_statistics": (index_statistics, STATISTICS_SQL),
}
