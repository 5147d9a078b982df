"""Queries: valley threshold, spatial neighbours, plane distances, mesh area, oriented boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import vectors
from lodestrata.operators import sampling, spatial

from . import fixtures as fx
from .volumes import quad

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


@query("valley_threshold", f"SELECT bin, n FROM (SELECT bin, n, lag(n) OVER (ORDER BY bin) AS before, lead(n) OVER (ORDER BY bin) AS after FROM (SELECT CAST(v // 10 AS INT) AS bin, count(*) AS n FROM ({fx.VOX}) GROUP BY 1)) WHERE n < before AND n <= after ORDER BY bin LIMIT 1")
def valley_threshold(spark, sf_dir):
    return spatial.valley(fx.vox(spark, sf_dir), 10)


NEAR = f"SELECT a.id, b.id AS other, (a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2 FROM ({fx.VEC3}) a, ({fx.VEC3}) b WHERE (a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 0.05 * 0.05"


@query("points_radius", f"SELECT id, count(*) AS n FROM ({NEAR}) GROUP BY id")
def points_radius(spark, sf_dir):
    v = fx.vec3(spark, sf_dir)
    return spatial.within_radius(v, v, 0.05).groupBy("id").agg(F.count("*").alias("n"))


@query("points_nearest", f"SELECT id, other, CAST(rank AS INT) AS rank FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS rank FROM ({NEAR}) WHERE id <> other) WHERE rank <= 3")
def points_nearest(spark, sf_dir):
    v = fx.vec3(spark, sf_dir)
    return spatial.nearest_k(v, v, 0.05, 3).select("id", "other", "rank")


@query("plane_project", f"SELECT id, round((z - 0.5) * 0.6 + (y - 0.25) * 0.8, 6) + 0.0 AS distance, round(z - 0.6 * ((z - 0.5) * 0.6 + (y - 0.25) * 0.8), 6) + 0.0 AS pz, round(y - 0.8 * ((z - 0.5) * 0.6 + (y - 0.25) * 0.8), 6) + 0.0 AS py, round(x, 6) + 0.0 AS px FROM ({fx.VEC3})")
def plane_project(spark, sf_dir):
    o, n = vectors.lit(0.5, 0.25, 0), vectors.lit(0.6, 0.8, 0)
    p = spatial.plane_project(vectors.vec(), o, n)
    return fx.vec3(spark, sf_dir).select("id", (F.round(spatial.plane_distance(vectors.vec(), o, n), 6) + 0.0).alias("distance"), *[(F.round(c, 6) + 0.0).alias(f"p{a}") for c, a in zip(p, "zyx", strict=True)])


@query("surface_area", "SELECT round(31 * 31 * sqrt(1 + 0.5 * 0.5 + 0.25 * 0.25), 4) AS area")
def surface_area(spark, sf_dir):
    return spatial.area(quad(spark)).select(F.round("area", 4).alias("area"))


BOX = "SELECT CAST(i // 64 AS INT) AS a, CAST(i // 8 % 8 AS INT) AS b, CAST(i % 8 AS INT) AS c, 20 + 0.8 * (i // 64) + 0.6 * (i // 8 % 8) AS z, 20 + 0.8 * (i // 8 % 8) - 0.6 * (i // 64) AS y, CAST(20 + i % 8 AS DOUBLE) AS x FROM range(512) r(i)"


@query("oriented_box", f"SELECT a, b, c, coalesce(v, 0) AS val FROM (SELECT a, b, c, CAST(round(z + 0.001) AS INT) AS z, CAST(round(y + 0.001) AS INT) AS y, CAST(round(x + 0.001) AS INT) AS x FROM ({BOX})) p LEFT JOIN ({fx.VOX}) q USING (z, y, x)")
def oriented_box(spark, sf_dir):
    box = spatial.oriented_box(spark, (20.001, 20.001, 20.001), ((0.8, -0.6, 0), (0.6, 0.8, 0), (0, 0, 1)), (8, 8, 8))
    return sampling.nearest(box.withColumn("id", F.struct("a", "b", "c")), fx.vox(spark, sf_dir)).select("id.a", "id.b", "id.c", "val")
