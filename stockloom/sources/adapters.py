"""The fixture tables read as frames, detections, catalogue and sessions, as DataFrames and as SQL for DuckDB.

Time is in hours since 2024-01-01, because the fixture's events are hours apart where frames are milliseconds apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.sources.tables import table

ORIGIN_US = 1_704_067_200_000_000
CLASSES = ("bottle", "can", "case")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion frames: walk_id, frame, us, t (hours), speed, px, lost, kind."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("walk_id"), F.row_number().over(order).cast("long").alias("frame"), us.alias("us"), ((us - ORIGIN_US) / 3.6e9).alias("t"), F.col("value").alias("speed"),
        F.get_json_object("props", "$.k").cast("double").alias("px"), (F.col("event_type") == "error").alias("lost"), F.col("event_type").alias("kind"),
    )


FRAMES = f"""frames AS (
  SELECT user_id AS walk_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame, epoch_us(ts) AS us,
    (epoch_us(ts) - {ORIGIN_US}) / 3.6e9 AS t, value AS speed, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS px,
    event_type = 'error' AS lost, event_type AS kind FROM events)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: walk_id (customer), commit_id (order), det_id, seq of the commit in its walk, box, score, cls, sku."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    det = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"
    )
    x0, y0 = (F.col("l_partkey") % 120).cast("double"), (F.col("l_suppkey") % 60).cast("double")
    return (
        li.withColumn("det_id", F.row_number().over(det).cast("long"))
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # first, while rows are dealt by the order
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("walk_id"), F.col("l_orderkey").alias("commit_id"), "det_id", F.col("o_orderdate").alias("at"), x0.alias("x0"), y0.alias("y0"),
            (x0 + 1 + F.col("p_size")).alias("x1"), (y0 + F.col("l_quantity")).alias("y1"), (F.lit(1.0) - F.col("l_discount")).alias("score"),
            F.col("p_type").alias("cls"), F.col("l_partkey").alias("sku"), F.col("l_linestatus").alias("side"),
        )
    )


DETECTIONS = """detections AS (
  SELECT o_custkey AS walk_id, l_orderkey AS commit_id, det_id, o_orderdate AS at, CAST(l_partkey % 120 AS DOUBLE) AS x0, CAST(l_suppkey % 60 AS DOUBLE) AS y0,
    CAST(l_partkey % 120 AS DOUBLE) + 1 + p_size AS x1, CAST(l_suppkey % 60 AS DOUBLE) + l_quantity AS y1, 1.0::DOUBLE - l_discount AS score, p_type AS cls,
    l_partkey AS sku, l_linestatus AS side
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
    l_returnflag, l_linestatus) AS BIGINT) AS det_id FROM lineitem) JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits: walk_id (customer), commit_id (order), n (1-based in the walk), t (days), price."""
    o = table(spark, sf_dir, "orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("walk_id"), F.col("o_orderkey").alias("commit_id"), F.row_number().over(order).cast("long").alias("n"), (us / 8.64e10).alias("t"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


COMMITS = """commits AS (
  SELECT o_custkey AS walk_id, o_orderkey AS commit_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n,
    epoch_us(o_orderdate) / 8.64e10 AS t, o_totalprice AS price, o_orderstatus AS status FROM orders)"""


def sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue: code, name, brand, category, units_per_case."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").cast("long").alias("units_per_case"))


SKU = "sku AS (SELECT p_partkey AS code, p_name AS name, p_brand AS brand, p_type AS category, CAST(p_size AS BIGINT) AS units_per_case FROM part)"


def with_sql(*parts: str) -> str:
    """A WITH clause of the given tables."""
    return "WITH " + ",\n".join(parts) + "\n"
