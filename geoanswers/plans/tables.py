"""The driver's tables, and the points, boxes, legs, cells and logs that closed formulas make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.functions import geom


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as points on a square of 1000 m."""
    c = table(spark, sf_dir, "customer")
    x, y = (F.col("c_custkey") * 7919) % 10000 / 10.0, (F.col("c_custkey") * 104729) % 10000 / 10.0
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), "c_nationkey", "c_acctbal", x.alias("x"), y.alias("y"), geom.point(x, y).alias("geom"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as points on the same square."""
    s = table(spark, sf_dir, "supplier")
    x, y = (F.col("s_suppkey") * 3571 + 37) % 10000 / 10.0, (F.col("s_suppkey") * 7717 + 11) % 10000 / 10.0
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), x.alias("x"), y.alias("y"), geom.point(x, y).alias("geom"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as boxes of 180 m on a pitch of 200 m."""
    n = table(spark, sf_dir, "nation")
    x, y = (F.col("n_nationkey") % 5 * 200).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 200).cast("double")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("region"), x.alias("x0"), y.alias("y0"), geom.box(x, y, x + 180, y + 180).alias("geom"))


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as boxes whose sides are p_size and a tenth of the price's last digits."""
    p = table(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") * 7919) % 10000 / 10.0, (F.col("p_partkey") * 104729) % 10000 / 10.0
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 13 + 1).cast("double")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), x.alias("x0"), y.alias("y0"), w.alias("w"), h.alias("h"), geom.box(x, y, x + w, y + h).alias("geom"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as traverse legs, one traverse an order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("traverse_id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 360).cast("double").alias("azimuth_deg"), F.col("l_quantity").alias("distance_m"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as raster cells, 100 columns wide."""
    return table(spark, sf_dir, "orders").select(F.lit(0).alias("raster_id"), F.floor(F.col("o_orderkey") / 100).cast("int").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), F.col("o_totalprice").alias("z"))
