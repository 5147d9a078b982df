"""Index arithmetic: block keys and addresses, linear layouts, pyramid geometry and slots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples along a block, blocks along a chunk, samples along a chunk, levels at most, samples along a volume at most.
BLOCK, PER_CHUNK, CHUNK, MAX_LODS, MAX_DIM = 16, 16, 256, 8, 1 << 20
FIELD = 16


def pack(lod: Column, z: Column, y: Column, x: Column) -> Column:
    """A block's key: three bits of level over 16 bits each of z, y and x. Keys order by level, then z, y, x; null is the empty key."""
    at = lambda c, mask, by: F.shiftleft(c.cast("long").bitwiseAND(F.lit(mask)), by)
    return at(lod, 7, 48).bitwiseOR(at(z, 0xFFFF, 32)).bitwiseOR(at(y, 0xFFFF, 16)).bitwiseOR(at(x, 0xFFFF, 0))


def unpack(key: Column) -> dict[str, Column]:
    part = lambda by, mask: F.shiftright(key, by).bitwiseAND(F.lit(mask)).cast("int")
    return {"lod": part(48, 7), "bz": part(32, 0xFFFF), "by": part(16, 0xFFFF), "bx": part(0, 0xFFFF)}


def linear(at: list[Column], dims: list[int | Column]) -> Column:
    """The offset of a place in an array whose last axis is fastest."""
    out = F.lit(0).cast("long")
    for a, n in zip(at, dims, strict=True):
        out = out * n + a
    return out


def strided(at: list[Column], strides: list[int]) -> Column:
    return sum((a.cast("long") * s for a, s in zip(at, strides, strict=True)), F.lit(0).cast("long"))


def div(a: Column, b: int) -> Column:
    """Integer division of non-negative numbers."""
    return F.floor(a / F.lit(b)).cast("int")


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / F.lit(b)).cast("long")


def align_up(a: Column, b: int) -> Column:
    return ceil_div(a, b) * b


def address(key: Column) -> dict[str, Column]:
    """The chunk a block lies in and its linear place there."""
    k = unpack(key)
    inner = linear([k[c] % PER_CHUNK for c in ("bz", "by", "bx")], [PER_CHUNK] * 3)
    return {"lod": k["lod"], "cz": div(k["bz"], PER_CHUNK), "cy": div(k["by"], PER_CHUNK), "cx": div(k["bx"], PER_CHUNK), "inner": inner.cast("int")}


def voxel_address(z: Column, y: Column, x: Column) -> dict[str, Column]:
    """The block a voxel lies in and its linear place there."""
    return {"bz": div(z, BLOCK), "by": div(y, BLOCK), "bx": div(x, BLOCK), "lin": linear([c % BLOCK for c in (z, y, x)], [BLOCK] * 3).cast("int")}


@dataclass(frozen=True)
class Geometry:
    """A volume's dimensions and levels; all else follows. Coarser levels round odd dimensions up, as the pyramid does."""

    dz: int
    dy: int
    dx: int
    lods: int = 1
    chunk: int = CHUNK

    def __post_init__(self) -> None:
        if not (1 <= self.lods <= MAX_LODS and all(1 <= d <= MAX_DIM for d in (self.dz, self.dy, self.dx))):
            raise ValueError(f"not a geometry: {self}")

    def levels(self, spark: SparkSession) -> DataFrame:
        """(lod, dz, dy, dx, ncz, ncy, ncx, chunks, base): dimensions, chunks along the axes, and the first slot, coarse levels first."""
        rows = spark.range(self.lods).select(F.col("id").cast("int").alias("lod"))
        size = lambda d: F.ceil(F.lit(d) / F.pow(F.lit(2.0), F.col("lod"))).cast("int")
        rows = rows.select("lod", size(self.dz).alias("dz"), size(self.dy).alias("dy"), size(self.dx).alias("dx"))
        rows = rows.select("*", *[ceil_div(F.col(d), self.chunk).cast("int").alias(f"nc{d[1]}") for d in ("dz", "dy", "dx")])
        rows = rows.withColumn("chunks", F.col("ncz").cast("long") * F.col("ncy") * F.col("ncx"))
        before = F.sum("chunks").over(Window.orderBy(F.desc("lod")).rowsBetween(Window.unboundedPreceding, -1))  # a row a level
        return rows.withColumn("base", F.coalesce(before, F.lit(0)).cast("long"))

    def slots(self, chunks: DataFrame) -> DataFrame:
        """Adds slot to (lod, cz, cy, cx): one number for each chunk of all levels. Chunks outside the volume go."""
        at = self.levels(chunks.sparkSession).select("lod", "ncz", "ncy", "ncx", "base")
        inside = (F.col("cz") < F.col("ncz")) & (F.col("cy") < F.col("ncy")) & (F.col("cx") < F.col("ncx"))
        slot = F.col("base") + linear([F.col("cz"), F.col("cy"), F.col("cx")], [F.col("ncz"), F.col("ncy"), F.col("ncx")])
        return chunks.join(F.broadcast(at), "lod").where(inside).withColumn("slot", slot).drop("ncz", "ncy", "ncx", "base")
