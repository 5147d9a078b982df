"""Surfaces as grids (v, u, z, y, x, nz, ny, nx): planes and quad meshes with their normals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import vectors

Triple = tuple[float, float, float]


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """Every (v, u) of a grid."""
    i = F.col("id")
    return spark.range(height * width).select(F.floor(i / width).cast("int").alias("v"), (i % width).cast("int").alias("u"))


def plane(spark: SparkSession, origin: Triple, along_u: Triple, along_v: Triple, normal: Triple, height: int, width: int) -> DataFrame:
    """An affine grid with one normal."""
    at = [F.lit(float(o)) + F.col("u") * F.lit(float(a)) + F.col("v") * F.lit(float(b)) for o, a, b in zip(origin, along_u, along_v, strict=True)]
    return grid(spark, height, width).select("v", "u", *[c.alias(n) for c, n in zip(at, "zyx", strict=True)], *[F.lit(float(c)).alias(f"n{n}") for c, n in zip(normal, "zyx", strict=True)])


def plane_basis(planes: DataFrame, normal: str = "n", up: str = "u") -> DataFrame:
    """Adds basis vectors bu and bv to rows with a normal (nz, ny, nx) and an up vector (uz, uy, ux).

    bu is the unit of up x normal, or of z x normal where up runs along the normal; bv the unit of normal x bu. Both
    are zero where the normal is parallel to up and z.
    """
    n, u = vectors.vec(normal), vectors.vec(up)
    first = vectors.cross(u, n)
    other = vectors.cross(vectors.lit(1, 0, 0), n)
    flat = vectors.length(first) < 1e-9
    bu = vectors.normalize(tuple(F.when(flat, o).otherwise(f) for f, o in zip(first, other, strict=True)))
    out = planes.select("*", *[c.alias(f"bu{a}") for c, a in zip(bu, "zyx", strict=True)])
    bv = vectors.normalize(vectors.cross(n, vectors.vec("bu")))
    return out.select("*", *[c.alias(f"bv{a}") for c, a in zip(bv, "zyx", strict=True)])


def quad_normals(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds unit normals to a grid of points: the cross product of the steps to the next u and the next v.

    The last row and column have no next point and so the zero vector.
    """
    along_u = Window.partitionBy(*by, "v").orderBy("u")
    along_v = Window.partitionBy(*by, "u").orderBy("v")
    step = lambda w, c: F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0.0))
    out = points.select("*", *[step(along_u, c).alias(f"_u{c}") for c in "zyx"])
    out = out.select("*", *[step(along_v, c).alias(f"_v{c}") for c in "zyx"])
    normal = vectors.normalize(vectors.cross(vectors.vec("_u"), vectors.vec("_v")))
    return out.select(*points.columns, *[c.alias(f"n{a}") for c, a in zip(normal, "zyx", strict=True)])


def quad_sample(points: DataFrame, at: DataFrame) -> DataFrame:
    """Points of a quad mesh at fractional places: at has (id, pv, pu); beyond the far edges the edge is used.

    Four neighbours a place, each found by an equality join on the grid.
    """
    edge = points.agg(F.max("v").alias("mv"), F.max("u").alias("mu"))
    inside = at.join(F.broadcast(edge), how="cross")  # one row
    clamp = lambda c, m: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(m).cast("double"))
    inside = inside.select("id", clamp("pv", "mv").alias("pv"), clamp("pu", "mu").alias("pu"), "mv", "mu")
    base = inside.select("*", F.floor("pv").cast("int").alias("v0"), F.floor("pu").cast("int").alias("u0"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("dv"), F.lit(b).alias("du")) for a in (0, 1) for b in (0, 1)]))
    near = base.withColumn("c", corner)
    fv, fu = F.col("pv") - F.col("v0"), F.col("pu") - F.col("u0")
    weight = F.when(F.col("c.dv") == 1, fv).otherwise(1 - fv) * F.when(F.col("c.du") == 1, fu).otherwise(1 - fu)
    near = near.select("id", F.least(F.col("v0") + F.col("c.dv"), F.col("mv")).alias("v"), F.least(F.col("u0") + F.col("c.du"), F.col("mu")).alias("u"), weight.alias("w"))
    return near.join(points, ["v", "u"]).groupBy("id").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in "zyx"])


def extent(points: DataFrame) -> DataFrame:
    """(gh, gw, points) of a grid."""
    return points.agg((F.max("v") + 1).cast("int").alias("gh"), (F.max("u") + 1).cast("int").alias("gw"), F.count("*").alias("points"))
