"""The driver's star schema and event tables as the library's abstractions. Only these functions know their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order: outcome from its status, stage and weapon from its customer, counts from its lines.

    An order without lines has null counts. The lines are summed before they meet the orders."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    summed = (
        lines.join(brands, lines.l_partkey == brands.p_partkey, "left")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.when(F.col("l_returnflag") == "A", 1)).cast("double").alias("kills"),
            F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("double").alias("deaths"),
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("disadvantage_seconds"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("advantage_seconds"),
            F.sum("l_quantity").alias("duration_seconds"),
            F.sort_array(F.collect_set("p_brand")).alias("enemy_weapons"),
        )
    )
    named = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    return named.join(summed, named.o_orderkey == summed.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("recorded_at"),
        F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "lose").alias("outcome"),
        F.col("n_name").alias("stage"),
        F.col("o_orderpriority").alias("rule"),
        F.col("c_mktsegment").alias("self_weapon"),
        F.coalesce("enemy_weapons", F.array().cast("array<string>")).alias("enemy_weapons"),
        "kills",
        "deaths",
        "disadvantage_seconds",
        "advantage_seconds",
        "duration_seconds",
        F.col("c_name").alias("recording_file_name"),
    )


#: The same view in DuckDB SQL, for the oracle queries.
MATCH_RECORDS_SQL = """
records AS (
  SELECT o.o_orderkey AS id, o.o_orderdate AS recorded_at,
    CASE o.o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'lose' END AS outcome,
    n.n_name AS stage, o.o_orderpriority AS rule, c.c_mktsegment AS self_weapon, c.c_name AS recording_file_name,
    coalesce(s.enemy_weapons, []) AS enemy_weapons, s.kills, s.deaths, s.disadvantage_seconds, s.advantage_seconds, s.duration_seconds
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (
    SELECT l_orderkey, (count(*) FILTER (l_returnflag = 'A'))::DOUBLE AS kills, (count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS deaths,
      sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS disadvantage_seconds,
      sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS advantage_seconds,
      sum(l_quantity) AS duration_seconds, list_sort(list(DISTINCT p_brand) FILTER (p_brand IS NOT NULL)) AS enemy_weapons
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
  ) s ON o.o_orderkey = s.l_orderkey
)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: ``key, t`` (epoch seconds), ``id``, ``kind``, ``value``, ``flag``, ``difference``."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.col("event_id").alias("id"),
        kind.alias("kind"),
        "value",
        (F.col("value") >= 20).alias("flag"),
        F.when(kind == "purchase", 1).when(kind == "error", -1).otherwise(0).alias("difference"),
    )


TIMELINE_SQL = """
timeline AS (
  SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, event_id AS id, event_type AS kind, value, value >= 20 AS flag,
    CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS difference
  FROM events
)"""
