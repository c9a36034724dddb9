"""The test tables as series and queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.validate import MOST_QUERY_BYTES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("series"))


def asked() -> Column:
    """Whether a row is a query: every id divisible by 50."""
    return F.col("id") % 50 == 0


def in_blocks(q: DataFrame, run: Callable[[DataFrame], DataFrame], most: int = MOST_QUERY_BYTES // 2) -> DataFrame:
    """The rows that ``run`` gives for queries (qid, q) of any number, each block of them about ``most`` bytes."""
    n = 1 + (q.agg(F.sum(F.size("q") * 8)).first()[0] or 0) // most
    if n == 1:
        return run(q)
    block = F.pmod(F.xxhash64("qid"), F.lit(n))
    held = sorted(r[0] for r in q.select(block).distinct().collect())  # n at most
    return reduce(DataFrame.unionByName, (run(q.where(block == i)) for i in held))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of every id divisible by 50, as queries."""
    return series(spark, sf_dir).where(asked()).select(F.col("id").alias("qid"), F.col("series").alias("q"))


def rounded(df: DataFrame) -> DataFrame:
    """Distances to six places, as both engines print them; ranks as BIGINT."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            df = df.withColumn(name, F.round(F.col(name).cast("double"), 6) + F.lit(0.0))
        elif kind in ("int", "smallint", "tinyint"):
            df = df.withColumn(name, F.col(name).cast("long"))
    return df
