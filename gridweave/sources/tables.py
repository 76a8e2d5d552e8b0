"""The driver's tables as fields, particles and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid

EMB3 = Grid((4, 4, 4), 1.0)
LAT8 = Grid((8, 8, 8), 1.0)
EVT2 = Grid((8, 8), 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb3(spark, sf_dir) -> DataFrame:
    """One periodic 4 x 4 x 4 lattice a vector: snap, x, y, z, f."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("snap"), F.posexplode("embedding").alias("i", "f"))
    return e.select("snap", (F.col("i") / 16).cast("int").alias("x"), ((F.col("i") / 4).cast("int") % 4).alias("y"), (F.col("i") % 4).alias("z"), F.col("f").cast("double").alias("f"))


def emb3v(spark, sf_dir) -> DataFrame:
    """Three consecutive vectors as one vector field: snap, x, y, z, vx, vy, vz; incomplete ones are left out."""
    e = emb3(spark, sf_dir).select(F.floor(F.col("snap") / 3).alias("snap"), (F.col("snap") % 3).alias("c"), "x", "y", "z", "f")
    pick = lambda k: F.max(F.when(F.col("c") == k, F.col("f")))
    g = e.groupBy("snap", "x", "y", "z").agg(pick(0).alias("vx"), pick(1).alias("vy"), pick(2).alias("vz"), F.count("*").alias("n"))
    return g.where("n = 3").drop("n")


def lat8(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    k = lambda c, a: (F.col(c) % 8).cast("int").alias(a)
    return l.groupBy(k("l_partkey", "x"), k("l_suppkey", "y"), k("l_orderkey", "z")).agg(
        F.avg("l_quantity").alias("qty"), (F.avg("l_extendedprice") / 1e4).alias("price"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax")
    )


def evt2(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("event_id") % 8).cast("int").alias("x"), (F.col("user_id") % 8).cast("int").alias("y")).agg(F.avg("value").alias("f"))


def part(spark, sf_dir) -> DataFrame:
    """Every line item as a particle with two vectors, a and b. The scales keep products off decimal rounding ties."""
    c = lambda n, s, a: (F.col(n).cast("double") * s).alias(a)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_quantity", 0.103712937, "ax"), c("l_discount", 10.1317371, "ay"), c("l_tax", 9.8713913, "az"),
        c("l_extendedprice", 1.0373717e-4, "bx"), c("l_quantity", 0.051973719, "bw"), ((F.col("l_discount") - F.col("l_tax")) * 1.0171331).alias("bz"),
    )


def points(spark, sf_dir) -> DataFrame:
    """The first three entries of every vector as a point."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), *(F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")))
