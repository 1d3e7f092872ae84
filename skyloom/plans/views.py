"""Scene-stack views over the driver's tables, in Spark and in SQL.

The same definitions twice: DataFrames for the queries, common table expressions
for their SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import good_share, ranked

WIDTH = 50
CLEAR_VIEW = (4, 5, 6, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as scenes."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        key.alias("scene_id"),
        (F.col("s_nationkey") % 5).cast("bigint").alias("orbit"),
        (key * 7 % 40).alias("nodata"),
        (key * 13 % 50).alias("cloud"),
        (key * 3 % 10).alias("shadow"),
        (F.lit("2023-06-01").cast("timestamp") + F.make_dt_interval(days=(key * 11 % 90).cast("int"))).alias("datetime"),
        (key % 20 * 3).cast("double").alias("x0"),
        (key % 7 * 5).cast("double").alias("y0"),
    )
    return rows.withColumn("good", good_share(F.col("nodata"), F.col("cloud"), F.col("shadow"))).withColumn("x1", F.col("x0") + 12.0).withColumn("y1", F.col("y0") + 9.5)


SCENES = """scenes AS (
  SELECT *, CAST(100 - nodata AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(cloud + shadow AS DOUBLE) / CAST(100 AS DOUBLE)) AS good, x0 + CAST(12 AS DOUBLE) AS x1, y0 + CAST(9.5 AS DOUBLE) AS y1
  FROM (SELECT s_suppkey AS scene_id, CAST(s_nationkey % 5 AS BIGINT) AS orbit, s_suppkey * 7 % 40 AS nodata, s_suppkey * 13 % 50 AS cloud, s_suppkey * 3 % 10 AS shadow,
               TIMESTAMP '2023-06-01' + to_days(CAST(s_suppkey * 11 % 90 AS INTEGER)) AS datetime, CAST(s_suppkey % 20 * 3 AS DOUBLE) AS x0, CAST(s_suppkey % 7 * 5 AS DOUBLE) AS y0 FROM supplier))"""

ORDER = """turns AS (
  SELECT *, row_number() OVER (PARTITION BY orbit ORDER BY good DESC, scene_id) AS turn, max(good) OVER (PARTITION BY orbit) AS best FROM scenes),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY turn, best DESC, lead_id) AS rank
  FROM (SELECT *, min(CASE WHEN turn = 1 THEN scene_id END) OVER (PARTITION BY orbit) AS lead_id FROM turns))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation of each (part, supplier): the smallest line."""
    line = table(spark, sf_dir, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    best = line.groupBy("l_partkey", "l_suppkey").agg(F.min(key).alias("o"))
    return best.select(
        F.col("l_partkey").alias("px"),
        F.expr(f"l_partkey div {WIDTH}").alias("row"),
        (F.col("l_partkey") % WIDTH).alias("col"),
        F.col("l_suppkey").alias("scene"),
        (F.floor("o.l_extendedprice") % 10000).alias("b1"),
        (F.round(F.col("o.l_discount") * 100).cast("bigint") * 100).alias("b2"),
        (F.round(F.col("o.l_tax") * 100).cast("bigint") * 100).alias("b3"),
        ((F.col("o.l_orderkey") + F.col("o.l_linenumber")) % 12).alias("scl"),
    )


OBS = f"""lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax) AS k FROM lineitem),
obs AS (
  SELECT l_partkey AS px, l_partkey // {WIDTH} AS row, l_partkey % {WIDTH} AS col, l_suppkey AS scene, CAST(floor(l_extendedprice) AS BIGINT) % 10000 AS b1,
         CAST(round(l_discount * 100) AS BIGINT) * 100 AS b2, CAST(round(l_tax * 100) AS BIGINT) * 100 AS b3, (l_orderkey + l_linenumber) % 12 AS scl
  FROM lines WHERE k = 1)"""


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear observations with the rank of their scene (the catalogue is small next to the pixels)."""
    order = ranked(scenes(spark, sf_dir), "valid_data").select(F.col("scene_id").alias("scene"), "rank")
    return observations(spark, sf_dir).where(F.col("scl").isin(*CLEAR_VIEW)).join(order, "scene")


MASKED = f"""{SCENES},
{ORDER},
{OBS},
masked AS (
  SELECT obs.*, ordered.rank FROM obs JOIN ordered ON obs.scene = ordered.scene_id WHERE scl IN (4, 5, 6, 11))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels (parts)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("px"), F.expr(f"p_partkey div {WIDTH}").alias("row"), (F.col("p_partkey") % WIDTH).alias("col"), F.col("p_size").alias("size"))


GRID = f"grid AS (SELECT p_partkey AS px, p_partkey // {WIDTH} AS row, p_partkey % {WIDTH} AS col, p_size AS size FROM part)"
