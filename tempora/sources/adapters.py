"""Event tables from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BIRTH, DEATH


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def meds_from_events(events: DataFrame) -> DataFrame:
    """Users as subjects: stays from signups and errors, values from purchases."""
    kind = F.col("event_type")
    code = F.when(kind == "signup", "ADMISSION").when(kind == "error", "DISCHARGE").when(kind == "purchase", "LAB/PURCHASE").when(kind == "click", "D_CLICK").otherwise("M_VIEW")
    value = F.when(kind == "purchase", F.col("value") / 600)
    dated = events.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("subject_id"), F.col("ts").cast("timestamp_ntz").alias("time"), code.alias("code"), value.alias("numeric_value"))
    users = events.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("last"))
    birth = F.expr("TIMESTAMP_NTZ '1950-01-01 00:00:00' + make_dt_interval(cast(user_id % 100 * 200 as int))")
    sex = F.when(F.col("user_id") % 2 == 0, "GENDER//F").otherwise("GENDER//M")
    row = lambda k, time, code: F.struct((-4 * F.col("user_id") - k).alias("row_id"), F.col("user_id").alias("subject_id"), time.cast("timestamp_ntz").alias("time"), code.alias("code"), F.lit(None).cast("double").alias("numeric_value"))
    death = F.when(F.col("user_id") % 7 == 0, row(3, F.expr("last + INTERVAL '1' DAY"), F.lit(DEATH)))
    made = users.select(F.explode(F.array_compact(F.array(row(1, birth, F.lit(BIRTH)), row(2, F.lit(None), sex), death))).alias("r")).select("r.*")
    return dated.unionByName(made)


EVENTS_SQL = """ev AS (
  SELECT event_id AS row_id, user_id AS subject_id, ts AS time,
    CASE event_type WHEN 'signup' THEN 'ADMISSION' WHEN 'error' THEN 'DISCHARGE' WHEN 'purchase' THEN 'LAB/PURCHASE' WHEN 'click' THEN 'D_CLICK' ELSE 'M_VIEW' END AS code,
    CASE WHEN event_type = 'purchase' THEN value / 600 END AS numeric_value
  FROM events
  UNION ALL SELECT -4 * user_id - 1, user_id, TIMESTAMP '1950-01-01' + to_days(CAST(user_id % 100 * 200 AS INTEGER)), 'DOB', NULL FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT -4 * user_id - 2, user_id, NULL, CASE WHEN user_id % 2 = 0 THEN 'GENDER//F' ELSE 'GENDER//M' END, NULL FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT -4 * user_id - 3, user_id, max(ts) + INTERVAL 1 DAY, 'DOD', NULL FROM events WHERE user_id % 7 = 0 GROUP BY user_id
)"""


def meds_from_orders(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Customers as subjects: orders and deliveries as codes, discounts as values."""
    null = F.lit(None).cast("double")
    born = F.expr("TIMESTAMP_NTZ '1940-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 15000 as int))")
    people = customer.select(
        F.explode(
            F.array(
                F.struct((-2 * F.col("c_custkey") - 1).alias("row_id"), F.col("c_custkey").alias("subject_id"), born.alias("time"), F.lit(BIRTH).alias("code"), null.alias("numeric_value")),
                F.struct((-2 * F.col("c_custkey") - 2).alias("row_id"), F.col("c_custkey").alias("subject_id"), F.lit(None).cast("timestamp_ntz").alias("time"), F.concat(F.lit("SEGMENT//"), "c_mktsegment").alias("code"), null.alias("numeric_value")),
            )
        ).alias("r")
    ).select("r.*")
    placed = orders.select((F.col("o_orderkey") * 1000).alias("row_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"), F.concat(F.lit("D_"), F.substring("o_orderpriority", 1, 1)).alias("code"), null.alias("numeric_value"))
    items = lineitem.join(orders.select("o_orderkey", "o_custkey"), lineitem.l_orderkey == orders.o_orderkey)
    code = F.concat(F.lit("M_"), "l_returnflag", "l_linestatus")
    sent = items.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("row_id"), F.col("o_custkey").alias("subject_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"), code.alias("code"), (F.col("l_discount") * 10).alias("numeric_value"))
    return people.unionByName(placed).unionByName(sent)


ORDERS_SQL = """od AS (
  SELECT -2 * c_custkey - 1 AS row_id, c_custkey AS subject_id, TIMESTAMP '1940-01-01' + to_days(CAST(c_custkey % 15000 AS INTEGER)) AS time, 'DOB' AS code, CAST(NULL AS DOUBLE) AS numeric_value FROM customer
  UNION ALL SELECT -2 * c_custkey - 2, c_custkey, NULL, 'SEGMENT//' || c_mktsegment, NULL FROM customer
  UNION ALL SELECT o_orderkey * 1000, o_custkey, o_orderdate, 'D_' || left(o_orderpriority, 1), NULL FROM orders
  UNION ALL SELECT l_orderkey * 1000 + l_linenumber, o_custkey, l_shipdate, 'M_' || l_returnflag || l_linestatus, l_discount * 10 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
