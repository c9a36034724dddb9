"""The relational categories that surround a search: Spark's own operators over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.queries.tables import table


def pricing(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    g = t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count("*").alias("n"))
    return g.select("l_returnflag", "l_linestatus", F.round("qty", 2).alias("qty"), F.round("revenue", 2).alias("revenue"), "n")


PRICING = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""


def nation_revenue(spark, d):
    t = {n: table(spark, d, n) for n in ("customer", "orders", "nation")}
    j = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 1).alias("revenue"), F.count("*").alias("n"))


NATION = "SELECT n_name, round(sum(o_totalprice), 1) AS revenue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def semi_and_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, on, "left_semi").select("c_custkey", F.lit("with").alias("kind")).unionByName(c.join(o, on, "left_anti").select("c_custkey", F.lit("without").alias("kind")))


SEMI = "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'with' ELSE 'without' END AS kind FROM customer"


def rollup(spark, d):
    r = table(spark, d, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return r.select(F.coalesce(F.col("c_nationkey").cast("long"), F.lit(-1)).alias("c_nationkey"), F.coalesce("c_mktsegment", F.lit("all")).alias("c_mktsegment"), "n")


ROLLUP = "SELECT coalesce(CAST(c_nationkey AS BIGINT), -1) AS c_nationkey, coalesce(c_mktsegment, 'all') AS c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)"


def latest_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 2").select("o_custkey", "o_orderkey", "rank")


LATEST = "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2"


def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    return c.intersect(s).select("k", F.lit("both").alias("kind")).unionByName(c.subtract(s).select("k", F.lit("customers").alias("kind"))).unionByName(c.union(s).distinct().select("k", F.lit("any").alias("kind")))


SETS = """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer), s AS (SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier)
SELECT k, 'both' AS kind FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT k, 'customers' FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT k, 'any' FROM (SELECT k FROM c UNION SELECT k FROM s)"""


def tumbling(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


TUMBLING = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def json_field(spark, d):
    return table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


JSON = "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {
    "rel_aggregate": (pricing, PRICING), "rel_join": (nation_revenue, NATION), "rel_semi_anti": (semi_and_anti, SEMI), "rel_rollup": (rollup, ROLLUP), "rel_window": (latest_orders, LATEST), "rel_set_ops": (set_operations, SETS),
    "rel_tumbling": (tumbling, TUMBLING), "rel_json": (json_field, JSON),
}
