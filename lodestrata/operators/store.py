"""Volumes as partitioned tables of coded blocks: chunk offset tables, occupancy, writing and pruned reading."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.keys import BLOCK, PER_CHUNK, Geometry, div, linear, strided, voxel_address
from lodestrata.functions.samples import DTYPES
from lodestrata.operators import cells, codec
from lodestrata.plans.rewrites import box_predicate

#: Bytes before a chunk's payloads: hash, quality and flags, then 4097 offsets.
HEADER = 16 + 4097 * 4
UNKNOWN, ALL_ZERO, REAL = 0, 1, 2


def offset_table(payloads: DataFrame, chunk: list[str], k: str = "k", size: str = "len") -> DataFrame:
    """Adds off, a present block's place in its chunk: the header and the payloads before it, by k."""
    before = F.sum(size).over(Window.partitionBy(*chunk).orderBy(k).rowsBetween(Window.unboundedPreceding, -1))
    return payloads.withColumn("off", F.coalesce(before, F.lit(0)) + HEADER)


def chunk_lengths(payloads: DataFrame, chunk: list[str], size: str = "len") -> DataFrame:
    """(chunk, length): where each chunk's payloads end."""
    return payloads.groupBy(*chunk).agg((F.sum(size) + HEADER).alias("length"))


def spans(offsets: DataFrame, lengths: DataFrame, chunk: list[str], k: str = "k") -> DataFrame:
    """(chunk, k, off, end, ok): each payload ends where the next begins, the last at its chunk's length; ok if that lies within the chunk."""
    following = F.lead("off").over(Window.partitionBy(*chunk).orderBy(k))
    out = offsets.select(*chunk, k, "off", following.alias("next")).join(lengths, chunk)
    end = F.coalesce("next", "length")
    return out.select(*chunk, k, "off", end.alias("end"), ((F.col("off") >= HEADER) & (F.col("off") <= end) & (end <= F.col("length"))).alias("ok"))


def state(requests: DataFrame, occupancy: DataFrame, at: list[str]) -> DataFrame:
    """requests with the state of their chunk; unknown where the map has none."""
    return requests.join(occupancy.select(*at, "state"), at, "left").withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))


def packed(occupancy: DataFrame) -> DataFrame:
    """(byte, bits): four states of two bits in a byte, by slot."""
    part = F.col("state") * F.pow(F.lit(4), F.col("slot") % 4)
    return occupancy.groupBy(F.floor(F.col("slot") / 4).alias("byte")).agg(F.sum(part).cast("int").alias("bits"))


def unpacked(bytes_: DataFrame, slots: int) -> DataFrame:
    """(slot, state) again."""
    two = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftright("bits", 2 * i).bitwiseAND(F.lit(3)).alias("state")) for i in range(4)]))
    return bytes_.select("byte", two.alias("s")).select((F.col("byte") * 4 + F.col("s.i")).alias("slot"), F.col("s.state").alias("state")).where(F.col("slot") < slots)


def latest(writes: DataFrame, at: list[str], order: list[str]) -> DataFrame:
    """Of several writes of a chunk the last."""
    rank = F.row_number().over(Window.partitionBy(*at).orderBy(*[F.desc(c) for c in order]))
    return writes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def blocks_of(voxels: DataFrame, chunk: int = BLOCK * PER_CHUNK) -> DataFrame:
    """(lod, cz, cy, cx, bz, by, bx, lin, val) of voxels (lod, z, y, x, v)."""
    a = voxel_address(F.col("z"), F.col("y"), F.col("x"))
    at = [div(F.col(c), chunk).alias(f"c{c}") for c in "zyx"]
    return voxels.where("v != 0").select("lod", *at, *[c.alias(n) for n, c in a.items()], F.col("v").cast("double").alias("val"))


BLOCK_KEY = ["lod", "cz", "cy", "cx", "bz", "by", "bx"]


CHUNK_KEY = BLOCK_KEY[:4]
STORED = "bz int, by int, bx int, payload binary, lod int, cz int, cy int, cx int"
HEADER_ROW = "dz int, dy int, dx int, lods int, chunk int, q double, dtype string, metadata map<string,string>"


@dataclass(frozen=True)
class Header:
    """What a stored volume says of itself: dimensions and levels, quality, sample type, and any names with values."""

    geometry: Geometry
    q: float
    dtype: str = "u8"
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.q > 0 or self.dtype not in DTYPES:
            raise ValueError(f"not a header: {self}")


def write_header(spark: SparkSession, path: str, header: Header) -> None:
    """Writes the one row that opens a volume; again for new metadata."""
    g = header.geometry
    row = (g.dz, g.dy, g.dx, g.lods, g.chunk, float(header.q), header.dtype, header.metadata)
    spark.createDataFrame([row], HEADER_ROW).coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def header_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEADER_ROW).parquet(f"{path}/header")


def read_header(spark: SparkSession, path: str) -> Header:
    """A volume's header. Anything but one good row raises ValueError: the volume is corrupt."""
    rows = header_rows(spark, path).take(2)
    if len(rows) != 1 or any(v is None for v in rows[0]):
        raise ValueError(f"corrupt: {path} has no header")
    dz, dy, dx, lods, chunk, q, dtype, metadata = rows[0]
    return Header(Geometry(dz, dy, dx, lods, chunk), q, dtype, metadata)


def inside(voxels: DataFrame, geometry: Geometry) -> DataFrame:
    """voxels (lod, z, y, x, v) as they are; one with material outside its level's dimensions, or of no level, fails the job."""
    size = lambda d: F.ceil(F.lit(d) / F.pow(F.lit(2.0), F.col("lod")))
    ok = F.col("lod").between(0, geometry.lods - 1)
    for c, d in zip("zyx", (geometry.dz, geometry.dy, geometry.dx), strict=True):
        ok = ok & (F.col(c) >= 0) & (F.col(c) < size(d))
    return voxels.withColumn("v", F.when(ok | (F.col("v") == 0), F.col("v")).otherwise(F.raise_error(F.lit("out_of_range: a voxel outside the volume"))))


def _coded(voxels: DataFrame, header: Header) -> DataFrame:
    coded = codec.encode_blocks(blocks_of(inside(voxels, header.geometry), header.geometry.chunk), BLOCK_KEY, header.q)
    return coded.select([f.split()[0] for f in STORED.split(", ")])


def _write_blocks(coded: DataFrame, path: str, mode: str) -> None:
    dealt = coded.repartition(*CHUNK_KEY).sortWithinPartitions(*BLOCK_KEY)
    dealt.write.partitionBy(*CHUNK_KEY).mode("overwrite").option("partitionOverwriteMode", mode).parquet(f"{path}/blocks")


def write_volume(voxels: DataFrame, path: str, header: Header) -> None:
    """Codes the blocks of voxels (lod, z, y, x, v) and writes them, a directory for each chunk, then the header.

    Air makes no rows and no directories. The header comes last, so a volume half written can't be opened.
    """
    _write_blocks(_coded(voxels, header), path, "static")
    write_header(voxels.sparkSession, path, header)


def ingest_volume(volume: DataFrame, path: str, threshold: int, header: Header) -> None:
    """Masks the air of cells (z, y, x, v), builds all levels of the header's geometry and writes them."""
    write_volume(cells.ingest(volume, threshold, header.geometry.lods), path, header)


def rewrite_chunks(voxels: DataFrame, path: str, chunks: DataFrame) -> None:
    """Replaces the named chunks (lod, cz, cy, cx) of a stored volume by their voxels (lod, z, y, x, v); all others stay.

    Voxels of other chunks are left out. A chunk without voxels becomes air: each one named leaves a row without payload,
    so that its directory is replaced in any case. Quality and chunk side are those of the volume.
    """
    spark = voxels.sparkSession
    header = read_header(spark, path)
    named = chunks.select(CHUNK_KEY).distinct()
    at = [div(F.col(c), header.geometry.chunk).alias(f"c{c}") for c in "zyx"]
    some = voxels.select("*", *at).join(named, CHUNK_KEY, "left_semi").select("lod", "z", "y", "x", "v")
    marks = named.select(*[F.lit(None).cast("int").alias(c) for c in ("bz", "by", "bx")], F.lit(None).cast("binary").alias("payload"), *CHUNK_KEY)
    _write_blocks(_coded(some, header).unionByName(marks), path, "dynamic")


def read_region(spark: SparkSession, path: str, lod: int, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """(z, y, x, v) of every place in a box, 0 for air. Chunk directories and row groups outside it aren't read, blocks outside not decoded.

    Quality and chunk side come from the volume's header.
    """
    header = read_header(spark, path)
    q, chunk = header.q, header.geometry.chunk
    stored = spark.read.schema(STORED).parquet(f"{path}/blocks")
    keep = F.col("lod") == lod
    for axis, a, n in zip("zyx", low, size, strict=True):
        keep = keep & F.col(f"c{axis}").between(a // chunk, (a + n - 1) // chunk) & F.col(f"b{axis}").between(a // BLOCK, (a + n - 1) // BLOCK)
    found = codec.decode_blocks(stored.where(keep).select("bz", "by", "bx", "payload"), q)
    out = found.select("bz", "by", "bx", F.posexplode("vox").alias("lin", "v")).where("v <> 0")
    z, y, x = F.floor(F.col("lin") / 256), F.floor(F.col("lin") / 16) % 16, F.col("lin") % 16
    out = out.select(*[(F.col(f"b{n}") * BLOCK + c).cast("int").alias(n) for n, c in (("z", z), ("y", y), ("x", x))], "v")
    return cells.dense_box(out, low, size)


def region(voxels: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int], chunk: int) -> DataFrame:
    """The cells of a box in a table with chunk and block columns; all three kinds of bounds reach the scan."""
    return voxels.where(box_predicate(low, size, chunk))


def offsets_of(box: DataFrame, low: tuple[int, int, int], strides: tuple[int, int, int]) -> DataFrame:
    """Adds at, the place of each cell of a box in an output with given strides."""
    at = [F.col(c) - a for c, a in zip("zyx", low, strict=True)]
    return box.withColumn("at", strided(at, list(strides)))


def linear_offsets(box: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    at = [F.col(c) - a for c, a in zip("zyx", low, strict=True)]
    return box.withColumn("at", linear(at, list(size)))
