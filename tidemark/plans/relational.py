"""Additions beyond versioned keys that Spark gives at once: joins, grouping sets, windows, set operations, event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


_CENTS = "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)"


@query(f"SELECT o_orderpriority, count(*) AS n, {_CENTS} AS cents FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def join_aggregate(spark, sf_dir):
    orders, lines = _tables(spark, sf_dir, "orders", "lineitem")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), cents.alias("cents"))


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    (lines,) = _tables(spark, sf_dir, "lineitem")
    out = lines.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query("SELECT n_name, c_custkey, place FROM (SELECT n_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE place <= 3")
def top_per_group(spark, sf_dir):
    customer, nation = _tables(spark, sf_dir, "customer", "nation")
    order = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = customer.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 3")
    return ranked.join(nation, ranked["c_nationkey"] == nation["n_nationkey"]).select("n_name", "c_custkey", "place")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_operations(spark, sf_dir):
    (orders,) = _tables(spark, sf_dir, "orders")
    who = lambda test: orders.where(test).select("o_custkey")
    return who("o_orderstatus = 'F'").intersect(who("o_orderstatus = 'O'")).subtract(who("o_orderpriority = '1-URGENT'"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def distinct_aggregate(spark, sf_dir):
    (events,) = _tables(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1")
def tumbling_windows(spark, sf_dir):
    (events,) = _tables(spark, sf_dir, "events")
    hour = F.unix_timestamp(F.date_trunc("hour", "ts")).cast("long")
    return events.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(us) - min(us) AS length_us FROM s GROUP BY user_id, session""")
def sessions(spark, sf_dir):
    (events,) = _tables(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = rows.withColumn("before", F.lag("us").over(order))
    new = (F.col("before").isNull() | (F.col("us") - F.col("before") > 1_800_000_000)).cast("long")
    rows = rows.withColumn("session", F.sum(new).over(order))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("length_us"))


@query("""SELECT s_suppkey, count(*) AS n FROM supplier JOIN part ON p_size BETWEEN s_suppkey % 50 AND s_suppkey % 50 + 2 GROUP BY s_suppkey""")
def range_join(spark, sf_dir):
    """An interval join as an equality: each interval is spelt as the few points it holds."""
    supplier, part = _tables(spark, sf_dir, "supplier", "part")
    low = F.col("s_suppkey") % 50
    points = supplier.select("s_suppkey", F.explode(F.sequence(low, low + 2)).alias("point"))
    sizes = part.groupBy(F.col("p_size").cast("long").alias("point")).agg(F.count("*").alias("m"))
    return points.join(sizes, "point").groupBy("s_suppkey").agg(F.sum("m").alias("n"))


@query("SELECT user_id, event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS most FROM events")
def moving_frame(spark, sf_dir):
    (events,) = _tables(spark, sf_dir, "events")
    frame = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return events.select("user_id", "event_id", F.count("*").over(frame).alias("n"), F.max("value").over(frame).alias("most"))
