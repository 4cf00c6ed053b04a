"""Image, volume and label views over the relational tables: one row per pixel or voxel."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP, WIDTH = 5, 50


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2D image: k, x, y, v (gray), gt (class), pred (class), sid (square tile)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    height = F.broadcast(o.agg((F.floor(F.max("o_orderkey") / WIDTH) + 1).alias("h")))  # one row
    k = F.col("o_orderkey")
    out = o.crossJoin(height).select(
        k.alias("k"), (k % WIDTH).alias("x"), F.floor(k / WIDTH).alias("y"), (F.floor("o_totalprice") % 256).alias("v"),
        F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("gt"), (F.col("o_custkey") % 3).cast("int").alias("pred"), "h")
    return out.withColumn("sid", F.floor(F.col("x") / STEP) * F.ceil(F.col("h") / STEP) + F.floor(F.col("y") / STEP))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume of 10 x 10 slices: x, y, z, v, gt, sid (cube, z major)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    out = o.select((k % 10).alias("x"), F.floor(k / 10).alias("r"), F.floor(k / 100).alias("z"), (F.floor("o_totalprice") % 256).alias("v"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("gt")).withColumn("y", F.col("r") % 10).drop("r")
    return out.withColumn("sid", F.floor(F.col("z") / STEP) * 4 + F.floor(F.col("x") / STEP) * 2 + F.floor(F.col("y") / STEP))
