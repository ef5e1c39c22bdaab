"""Routing inputs projected from the star-schema tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron.functions.geo import box
from squadron.schemas import half

DEPOT = (146.175, -16.84)
N_TENDERS = 3
W_MS, W_T = half(0.2), half(0.075)
DRAFT_MS, DRAFT_T = -10, -5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: str) -> list:
    k = F.col(key)
    return [(F.lit(146.0) + (k * 7919) % 10007 / F.lit(10007.0)).alias("x"), (F.lit(-17.0) + (k * 104729) % 10009 / F.lit(10009.0)).alias("y")]


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, node_id, x, y, cluster_id): runs are the clusters' ids modulo 5."""
    c = table(spark, sf_dir, "customer")
    return c.select((F.col("c_nationkey") % 5).cast("bigint").alias("run_id"), F.col("c_custkey").alias("node_id"), *place("c_custkey"), (F.col("c_nationkey") + 1).cast("bigint").alias("cluster_id"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), *place("s_suppkey"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disturbance boxes: (row_idx, x0, y0, x1, y1, ring, hs_mean)."""
    i = F.col("n_nationkey")
    b = table(spark, sf_dir, "nation").select(i.cast("int").alias("row_idx"), (F.lit(146.0) + i % 5 / F.lit(5.0)).alias("x0"), (F.lit(-17.0) + F.floor(i / 5) / F.lit(5.0)).alias("y0"), (i % 7 / F.lit(10.0)).alias("hs_mean"))
    b = b.withColumn("x1", F.col("x0") + F.lit(0.2)).withColumn("y1", F.col("y0") + F.lit(0.2))
    return b.withColumn("ring", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third box, shrunk to its middle half: (poly_idx, x0, y0, x1, y1, ring)."""
    b = boxes(spark, sf_dir).where("row_idx % 3 = 0").select((F.col("row_idx") / 3 + 1).cast("int").alias("poly_idx"), (F.col("x0") + F.lit(0.05)).alias("x0"), (F.col("y0") + F.lit(0.05)).alias("y0"))
    b = b.withColumn("x1", F.col("x0") + F.lit(0.1)).withColumn("y1", F.col("y0") + F.lit(0.1))
    return b.withColumn("ring", box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, iy, v): cells without a row are missing."""
    q = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 40).cast("int").alias("ix"), (F.col("l_suppkey") % 40).cast("int").alias("iy"))
    return q.agg((-(F.sum(F.col("l_quantity").cast("bigint")) % 20)).cast("double").alias("v"))


def sorties(spark: SparkSession, sf_dir: str, n_tenders: int = N_TENDERS) -> DataFrame:
    """Given sorties: (run_id, cluster_id, sortie_id, stop_idx, node_id, x, y)."""
    from pyspark.sql.window import Window as W

    rn = F.row_number().over(W.partitionBy("cluster_id").orderBy("node_id"))
    t = targets(spark, sf_dir).withColumn("rn", rn)
    return t.select("run_id", "cluster_id", ((F.col("rn") - 1) % n_tenders + 1).cast("int").alias("sortie_id"), (F.floor((F.col("rn") - 1) / n_tenders) + 1).cast("int").alias("stop_idx"), "node_id", "x", "y")


#: The same inputs for the SQL engine.
SQL = """
targets AS (SELECT CAST(c_nationkey % 5 AS BIGINT) AS run_id, c_custkey AS node_id, CAST(146.0 AS DOUBLE) + ((c_custkey * 7919) % 10007) / CAST(10007.0 AS DOUBLE) AS x,
 CAST(-17.0 AS DOUBLE) + ((c_custkey * 104729) % 10009) / CAST(10009.0 AS DOUBLE) AS y, CAST(c_nationkey + 1 AS BIGINT) AS cluster_id FROM customer),
sites AS (SELECT s_suppkey AS node_id, CAST(146.0 AS DOUBLE) + ((s_suppkey * 7919) % 10007) / CAST(10007.0 AS DOUBLE) AS x, CAST(-17.0 AS DOUBLE) + ((s_suppkey * 104729) % 10009) / CAST(10009.0 AS DOUBLE) AS y FROM supplier),
boxes0 AS (SELECT n_nationkey AS row_idx, CAST(146.0 AS DOUBLE) + (n_nationkey % 5) / CAST(5.0 AS DOUBLE) AS x0, CAST(-17.0 AS DOUBLE) + (n_nationkey // 5) / CAST(5.0 AS DOUBLE) AS y0, (n_nationkey % 7) / CAST(10.0 AS DOUBLE) AS hs_mean FROM nation),
boxes AS (SELECT *, x0 + CAST(0.2 AS DOUBLE) AS x1, y0 + CAST(0.2 AS DOUBLE) AS y1 FROM boxes0),
obstacles0 AS (SELECT CAST(row_idx // 3 + 1 AS INTEGER) AS poly_idx, x0 + CAST(0.05 AS DOUBLE) AS x0, y0 + CAST(0.05 AS DOUBLE) AS y0 FROM boxes WHERE row_idx % 3 = 0),
obstacles AS (SELECT *, x0 + CAST(0.1 AS DOUBLE) AS x1, y0 + CAST(0.1 AS DOUBLE) AS y1 FROM obstacles0),
cells AS (SELECT CAST(l_partkey % 40 AS INTEGER) AS ix, CAST(l_suppkey % 40 AS INTEGER) AS iy, CAST(-(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) % 20) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
sorties AS (SELECT run_id, cluster_id, CAST((rn - 1) % 3 + 1 AS INTEGER) AS sortie_id, CAST((rn - 1) // 3 + 1 AS INTEGER) AS stop_idx, node_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY node_id) AS rn FROM targets))
"""


def metres(ax: str, ay: str, bx: str, by: str) -> str:
    """SQL of the great-circle distance."""
    return f"(12742000.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians({by}) - radians({ay})) / 2), 2) + cos(radians({ay})) * cos(radians({by})) * pow(sin((radians({bx}) - radians({ax})) / 2), 2)))))"
