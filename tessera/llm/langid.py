"""Language ID by nearest centroid: TF-IDF vectors of byte n-grams, several centroids a language, cosine, rejection.

A text's vector counts its byte 1-, 2- and 3-grams (A-Z lower-cased, runs of other ASCII as one space) in ``dim`` hashed places, takes log(1 + count),
weighs by inverse document frequency over all training documents, and has length 1. Each language's sampled vectors
are clustered into ``clusters`` centroids (spherical k-means, farthest-first starts). The language of the nearest
centroid wins; a text is rejected when it has no letter, or when its cosine is under ``slack`` times the first
percentile that windows of its length, cut from the middle of the language's sampled texts, have: short texts have lower
cosines than long ones, so one limit can't serve both. Texts under 8 bytes are rejected only if they have no letter.

The fit reads a sample of about ``sample`` labelled documents a language, chosen by a hash of id and text (four times as
many at most); document frequencies are counted over all training documents, and every whole text is scored. A task
clusters each language; the driver gets ``clusters`` centroids and ten limits a language.

Null, empty and letterless texts get ``und`` and score 0. Ties go to the language that is first in code-point order.
Without any labelled document every text gets ``und``. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import release
from tessera.llm._text import LOWER, as_buffer, pieces

DIM = 4096
SAMPLE = 256
CLUSTERS = 3
SLACK = 0.7
#: Windows of 2^LENGTHS bytes set the limits.
LENGTHS = range(3, 12)
#: More labels than this are taken for a mistake in the label column.
MOST_LANGUAGES = 1000
#: A-Z lower-cased, every other byte of ASCII that is no letter a space.
_PLAIN = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 0x20).astype(np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # rows of length 1
    owner: np.ndarray  # the language of each row
    least: np.ndarray  # by language and length (log2 of bytes): the cosine under which it rejects


def blocks(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``rows`` whole texts and, unless one text alone is longer, 1 MB."""
    data, offsets = as_buffer(column)
    for a, b, d, o in pieces(data, offsets, 1 << 20):
        for r in range(0, b - a, rows):
            e = min(b - a, r + rows)
            yield a + r, a + e, d[o[r] : o[e]], o[r : e + 1] - o[r]


def gram_counts(data: np.ndarray, offsets: np.ndarray, dim: int) -> np.ndarray:
    """Matrix of hashed n-gram counts, a row for each text."""
    n = len(offsets) - 1
    plain = _PLAIN[data]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    again = np.zeros(len(plain), bool)
    again[1:] = (plain[1:] == 0x20) & (plain[:-1] == 0x20) & (owner[1:] == owner[:-1])
    code, owner = plain[~again].astype(np.uint32), owner[~again]
    shift = np.uint32(32 - (dim - 1).bit_length())
    out = np.zeros(n * dim, np.int64)
    grams = code
    for k in range(3):
        if k:
            grams = (grams[:-1] << np.uint32(8)) | code[k:]
        same = owner[: len(grams)] == owner[k:] if len(grams) else np.zeros(0, bool)
        place = ((grams + np.uint32(k << 24)) * np.uint32(2654435761)) >> shift
        out += np.bincount(owner[: len(grams)][same] * np.int64(dim) + place[same], minlength=n * dim)
    return out.reshape(n, dim)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k centroids of length 1 for the rows of x."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
    c = x[start]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[nearest == i].sum(axis=0) if (nearest == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM, sample: int = SAMPLE, clusters: int = CLUSTERS, slack: float = SLACK) -> Model:
    """Learns from the rows of ``df`` whose label and text are not null."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(dim, np.int64), 0
        for batch in batches:
            for a, b, d, o in blocks(batch.column(0)):
                seen += (gram_counts(d, o, dim) > 0).sum(axis=0)
                n += b - a
            release()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(np.append(seen, n))], ["place", "n"])

    found = {r["place"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    n = found.get(dim, 0)
    idf = np.array([np.log((1 + n) / (1 + found.get(i, 0))) + 1 for i in range(dim)], np.float32)
    if not sizes:
        return Model((), idf, np.zeros((0, dim), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS.stop)))

    limits = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, sample / v) * 2**31)))))
    chosen = rows.where(F.xxhash64(F.lit(17), F.col("id"), F.col("text")).bitwiseAND(2**31 - 1) < limits[F.col("lang")])

    def learn(table: pa.Table) -> pa.Table:
        raw = sorted(x.as_py().encode() for x in table["text"])
        whole = _matrix(raw, idf)
        c = cluster(whole, clusters)
        least = [0.0] * LENGTHS.start
        for e in LENGTHS:
            windows = [x[(len(x) - 2**e) // 2 :][: 2**e].decode(errors="ignore").encode() for x in raw if len(x) >= 2**e]
            least.append(slack * float(np.percentile((_matrix(windows, idf) @ c.T).max(axis=1), 1)) if windows else least[-1])
        return pa.table({"lang": [table["lang"][0].as_py()], "centroids": [c.astype(np.float32).tobytes()], "least": [least]}, schema=pa.schema([("lang", pa.string()), ("centroids", pa.binary()), ("least", pa.list_(pa.float64()))]))

    drawn = chosen.select("text", "lang").limit(4 * sample * len(sizes))
    found = sorted(drawn.groupBy("lang").applyInArrow(learn, "lang string, centroids binary, least array<double>").collect(), key=lambda r: r["lang"].encode())
    if not found:
        return Model((), idf, np.zeros((0, dim), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS.stop)))
    centroids = [np.frombuffer(r["centroids"], np.float32).reshape(-1, dim) for r in found]
    owner = np.repeat(np.arange(len(found)), [len(c) for c in centroids])
    return Model(tuple(r["lang"] for r in found), idf, np.concatenate(centroids), owner, np.array([r["least"] for r in found]))


def _matrix(raw: list[bytes], idf: np.ndarray) -> np.ndarray:
    """The vectors of texts."""
    parts = [vectors(gram_counts(d, o, len(idf)), idf) for _, _, d, o in blocks(pa.array([x.decode() for x in raw], pa.large_string()))]
    return np.concatenate(parts) if parts else np.zeros((0, len(idf)), np.float32)


def predict(df: DataFrame, model: Model, keep: dict[str, str], text_col: str = "text") -> DataFrame:
    """Columns of ``df`` under new names, and lang_pred, score (the cosine) and rejected, for every row."""
    kinds = ", ".join(f"{new} {df.schema[old].dataType.simpleString()}" for old, new in keep.items())
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            column = batch.column(len(keep))
            for a, b, d, o in blocks(column):
                letters = np.concatenate(([0], np.cumsum(_LETTER[d])))[o]
                has = np.diff(letters) > 0
                for i in np.flatnonzero(~has & (np.diff(o) > 0)):
                    has[i] = any(c.isalpha() for c in column[a + int(i)].as_py())
                if m.languages:
                    cosines = vectors(gram_counts(d, o, len(m.idf)), m.idf) @ m.centroids.T
                    best = cosines.argmax(axis=1)
                    lang = np.where(has, m.owner[best], len(m.languages))
                    score = np.where(has, np.clip(cosines[np.arange(b - a), best], 0, 1), 0.0).astype(np.float64)
                    length = np.minimum(np.floor(np.log2(np.maximum(np.diff(o), 1))).astype(np.int64), LENGTHS.stop - 1)
                    rejected = ~has | (score < m.least[m.owner[best], length])
                else:
                    lang, score, rejected = np.zeros(b - a, int), np.zeros(b - a), np.ones(b - a, bool)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(names[lang], pa.string()), pa.array(score), pa.array(rejected)], [*keep.values(), "lang_pred", "score", "rejected"]
                )
            release()

    return df.select(*(F.col(x).alias(y) for x, y in keep.items()), F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, out: int = 2) -> DataFrame:
    """One row for each row of ``df``: id, held_out, lang_pred, score, rejected; learns from the rows outside fold ``out``."""
    model = fit(df.where(fold(id_col, folds) != out), id_col, text_col, lang_col)
    marked = df.select(F.col(id_col).alias("id"), (fold(id_col, folds) == out).alias("held_out"), F.col(text_col).alias("text"))
    return predict(marked, model, {"id": "id", "held_out": "held_out"}).withColumnRenamed("id", id_col)
