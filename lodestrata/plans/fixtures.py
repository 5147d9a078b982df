"""Volumes, tiles, requests and bytes derived from the star-schema tables; each as a DataFrame and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64

VOX = "SELECT CAST(l_orderkey % 64 AS INT) AS z, CAST(l_partkey % 64 AS INT) AS y, CAST(l_suppkey % 64 AS INT) AS x, CAST(max(CAST(floor(l_quantity) AS INT) * 5) AS INT) AS v FROM lineitem GROUP BY 1, 2, 3"
MASKED = f"SELECT * FROM ({VOX}) WHERE v > 50"
TILE = "SELECT vec_id // 64 AS tile, CAST(vec_id % 64 AS INT) AS v, CAST(u.i - 1 AS INT) AS u, CAST(embedding[u.i] AS DOUBLE) * 255 AS val FROM embeddings, range(1, 65) AS u(i)"
VEC3 = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS z, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS x FROM embeddings"
REQ = "SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS tick, user_id AS consumer, CAST(event_id % 4 AS BIGINT) AS bz, CAST(user_id % 4 AS BIGINT) AS \"by\", CAST(CAST(floor(value) AS INT) % 4 AS BIGINT) AS bx FROM events"
OCC = f"""SELECT cz, cy, cx, slot, CASE WHEN slot % 7 = 0 THEN 0 WHEN n > 0 THEN 2 ELSE 1 END AS state FROM (
  SELECT CAST(i // 16 AS INT) AS cz, CAST(i // 4 % 4 AS INT) AS cy, CAST(i % 4 AS INT) AS cx, i AS slot,
    (SELECT count(*) FROM ({VOX}) q WHERE q.z // 16 = i // 16 AND q.y // 16 = i // 4 % 4 AND q.x // 16 = i % 4) AS n FROM range(64) r(i))"""
PAYLOAD = "SELECT doc_id, CAST(doc_id % 4096 AS INT) AS k, CAST(strlen(text) AS BIGINT) AS len FROM documents"
RGB = "SELECT p_partkey, CAST(p_size * 5 % 256 AS INT) AS r, CAST(p_partkey % 256 AS INT) AS g, CAST(p_partkey * 7 % 256 AS INT) AS b FROM part"
COEF = "SELECT l_orderkey AS o, l_linenumber AS n, l_discount * l_quantity * 10 - l_tax * 100 AS c FROM lineitem"
PLANE = "SELECT CAST(i // 16 AS INT) AS v, CAST(i % 16 AS INT) AS u, CAST(32 AS DOUBLE) AS z, CAST(8 + i // 16 AS DOUBLE) AS y, CAST(8 + i % 16 AS DOUBLE) AS x FROM range(256) r(i)"
QUAD = "SELECT CAST(i // 32 AS INT) AS v, CAST(i % 32 AS INT) AS u, 20 + 0.5 * (i % 32) + 0.25 * (i // 32) AS z, CAST(8 + i // 32 AS DOUBLE) AS y, CAST(8 + i % 32 AS DOUBLE) AS x FROM range(1024) r(i)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: (F.col(c) % SIDE).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(at("l_orderkey").alias("z"), at("l_partkey").alias("y"), at("l_suppkey").alias("x"), (F.floor("l_quantity").cast("int") * 5).alias("v"))
    return rows.groupBy("z", "y", "x").agg(F.max("v").alias("v"))


def tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("tile"), (F.col("vec_id") % 64).cast("int").alias("v"), F.posexplode("embedding").alias("u", "e"))
    return rows.select("tile", "v", "u", (F.col("e").cast("double") * 255).alias("val"))


def vec3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(c) for i, c in enumerate("zyx")])


def req(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_diff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "events").select(day.alias("tick"), F.col("user_id").alias("consumer"), (F.col("event_id") % 4).alias("bz"), (F.col("user_id") % 4).alias("by"), (F.floor("value").cast("int") % 4).cast("long").alias("bx"))


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the 4 x 4 x 4 chunks of 16 samples a side: 2 where any cell is, 1 where none is, and 0 in every seventh slot."""
    at = [F.floor(F.col(c) / 16).cast("int").alias(f"c{c}") for c in "zyx"]
    real = vox(spark, sf_dir).select(*at).distinct().withColumn("real", F.lit(True))
    i = F.col("id")
    slots = spark.range(64).select(F.floor(i / 16).cast("int").alias("cz"), (F.floor(i / 4) % 4).cast("int").alias("cy"), (i % 4).cast("int").alias("cx"), i.alias("slot"))
    state = F.when(F.col("slot") % 7 == 0, 0).when(F.col("real"), 2).otherwise(1)
    return slots.join(real, ["cz", "cy", "cx"], "left").select("cz", "cy", "cx", "slot", state.alias("state"))


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4096).cast("int").alias("k"), F.octet_length("text").cast("long").alias("len"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5 % 256).cast("int").alias("r"), (p % 256).cast("int").alias("g"), (p * 7 % 256).cast("int").alias("b"))


def coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("l_discount") * F.col("l_quantity") * 10 - F.col("l_tax") * 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), c.alias("c"))
