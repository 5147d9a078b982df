"""Byte formats: ranged reads of files, chunk images with their hash, and segment containers, with Spark data sources for them."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lodestrata.operators import codec

BLOCKS, ABSENT, HEADER = 4096, 0xFFFFFFFF, 16 + 4097 * 4
U64 = (1 << 64) - 1
#: Fixed values of the chunk hash.
SEED, LENGTH, LANE, BYTE, END_1, END_2 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0x100000001B3, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
#: Fixed values of the segment container: magic, version, tile side, and bytes of its header and of a table row.
MAGIC, VERSION, SIDE, TOP, ROW = 0x53434D4D, 1, 64, 16, 24


def _turned(x: int, by: int) -> int:
    return (x << by | x >> (64 - by)) & U64


def chunk_hash(data: bytes) -> int:
    """The format's own 64-bit hash: eight bytes at a time, then single bytes, then an avalanche."""
    h = SEED ^ (len(data) * LENGTH & U64)
    whole = len(data) // 8
    for k in struct.unpack_from(f"<{whole}Q", data):
        h = _turned(h ^ (k * LANE & U64), 31) * LENGTH & U64
    for b in data[whole * 8 :]:
        h = _turned(h ^ (b * BYTE & U64), 23)
    for by, factor in ((33, END_1), (29, END_2)):
        h = (h ^ h >> by) * factor & U64
    return h ^ h >> 32


def build_chunk(payloads: dict[int, bytes], quality: float = 1.0) -> bytes:
    """A chunk image: hash, quality, flags, offsets of 4096 blocks and the end, payloads in order of block."""
    offsets, at = [ABSENT] * BLOCKS, HEADER
    for k in sorted(k for k, p in payloads.items() if p):
        offsets[k] = at
        at += len(payloads[k])
    body = struct.pack("<fI", quality, 0) + struct.pack(f"<{BLOCKS + 1}I", *offsets, at) + b"".join(payloads[k] for k in sorted(payloads))
    return struct.pack("<Q", chunk_hash(body)) + body


@dataclass(frozen=True)
class Chunk:
    """A view of a chunk image that never reads outside it, whatever its offsets say."""

    data: bytes

    @property
    def offsets(self) -> np.ndarray:
        return np.frombuffer(self.data, "<u4", BLOCKS + 1, 16) if len(self.data) >= HEADER else np.full(BLOCKS + 1, ABSENT, "<u4")

    def length(self) -> int:
        return int(self.offsets[BLOCKS])

    def quality(self) -> float:
        return struct.unpack_from("<f", self.data, 8)[0] if len(self.data) >= 12 else 0.0

    def verify(self) -> bool:
        n = self.length()
        return HEADER <= n <= len(self.data) and chunk_hash(self.data[8:n]) == struct.unpack_from("<Q", self.data)[0]

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        o = self.offsets
        here = np.flatnonzero(o[:BLOCKS] != ABSENT)
        ends = [*o[here[1:]].tolist(), self.length()] if len(here) else []
        for k, end in zip(here.tolist(), ends, strict=True):
            start = int(o[k])
            if HEADER <= start <= end <= len(self.data):
                yield k, self.data[start:end]


def ranged(content: Column, offset: Column, length: Column) -> Column:
    """Bytes of binary content from offset on (from 0); null outside it."""
    inside = (offset >= 0) & (length >= 0) & (offset + length <= F.octet_length(content))
    return F.when(inside, F.substring(content, offset + 1, length))


def read_files(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """ranges (name, offset, length) of files in a folder with their bytes and a status: ok, out_of_range or io."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    out = ranges.join(files, "name", "left").withColumn("bytes", ranged(F.col("content"), F.col("offset"), F.col("length")))
    status = F.when(F.col("content").isNull(), "io").when(F.col("bytes").isNull(), "out_of_range").otherwise("ok")
    return out.withColumn("status", status).drop("content")


def encode_segments(points: DataFrame, q: float) -> DataFrame:
    """(surface, ty, tx, payload) of surface points (surface, v, u, z, y, x): tiles of 64 x 64, padded with zeros."""
    parts = [F.struct(F.lit(c).alias("channel"), F.col(a).cast("double").alias("val")) for c, a in enumerate("zyx")]
    lin = (F.col("v") % SIDE) * SIDE + F.col("u") % SIDE
    rows = points.select("surface", F.floor(F.col("v") / SIDE).cast("int").alias("ty"), F.floor(F.col("u") / SIDE).cast("int").alias("tx"), lin.alias("at"), F.explode(F.array(*parts)).alias("p"))
    rows = rows.select("surface", "ty", "tx", (F.col("p.channel") * SIDE * SIDE + F.col("at")).cast("int").alias("lin"), F.col("p.val").alias("val"))
    preset = codec.PRESETS["surface"]

    def make(dense):
        return np.arange(len(dense)), [codec.encode_tiles(dense.reshape(-1, 3, SIDE, SIDE), q, preset)]

    return codec.per_block(rows, ["surface", "ty", "tx"], 3 * SIDE * SIDE, make, "surface int, ty int, tx int, payload binary")


def segment_table(tiles: DataFrame) -> DataFrame:
    """(surface, off, len): where each surface's tiles stand in a container, by prefix sums over a row a surface."""
    from pyspark.sql import Window

    sizes = tiles.groupBy("surface").agg(F.sum(F.octet_length("payload") + 4).alias("len"))
    n = F.count("*").over(Window.partitionBy())
    before = F.coalesce(F.sum("len").over(Window.orderBy("surface").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("surface", (F.lit(TOP) + n * ROW + before).alias("off"), "len")


def decode_segments(tiles: DataFrame, q: float, gh: int, gw: int) -> DataFrame:
    """(surface, v, u, z, y, x) again, without the padding."""
    preset = codec.PRESETS["surface"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lin = np.arange(SIDE * SIDE)
        for whole in batches:
            for start in range(0, whole.num_rows, codec.LANES // 16):
                b = whole.slice(start, codec.LANES // 16)
                z, y, x = np.moveaxis(codec.decode_tiles(b.column("payload").to_pylist(), q, preset).reshape(b.num_rows, 3, -1), 1, 0)
                surface, ty, tx = (np.repeat(b.column(c).to_numpy(), len(lin)) for c in ("surface", "ty", "tx"))
                at = np.tile(lin, b.num_rows)
                v, u = ty * SIDE + at // SIDE, tx * SIDE + at % SIDE
                here = (v < gh) & (u < gw)
                every = [surface, v, u, z.ravel(), y.ravel(), x.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c[here], t) for c, t in zip(every, [pa.int32()] * 3 + [pa.float64()] * 3, strict=True)], names=["surface", "v", "u", "z", "y", "x"])

    return tiles.select("surface", "ty", "tx", "payload").mapInArrow(of, "surface int, v int, u int, z double, y double, x double")


CHUNK_ROWS = "cz int, cy int, cx int, k int, payload binary"


@dataclass
class ChunkFile(InputPartition):
    path: str


class ChunkReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"].removeprefix("file://")

    def partitions(self) -> list[ChunkFile]:
        return [ChunkFile(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".chunk")] or [ChunkFile("")]

    def read(self, partition: ChunkFile) -> Iterator[tuple]:
        if not partition.path:
            return
        at = [int(x) for x in os.path.basename(partition.path).removesuffix(".chunk").split("-")]
        with open(partition.path, "rb") as f:
            chunk = Chunk(f.read())
        if not chunk.verify():
            raise ValueError(f"{partition.path}: the chunk is damaged")
        for k, payload in chunk.blocks():
            yield (*at, k, payload)


@dataclass
class Written(WriterCommitMessage):
    files: int


class ChunkWriter(DataSourceWriter):
    """Rows of a task by chunk; the input must hold a chunk's blocks in one partition."""

    def __init__(self, options) -> None:
        self.path = options["path"].removeprefix("file://")

    def write(self, iterator: Iterator) -> Written:
        by: dict[tuple, dict[int, bytes]] = {}
        for r in iterator:
            by.setdefault((r.cz, r.cy, r.cx), {})[r.k] = bytes(r.payload)
        os.makedirs(self.path, exist_ok=True)
        for at, payloads in by.items():
            final = os.path.join(self.path, "-".join(map(str, at)) + ".chunk")
            draft = f"{final}.{os.getpid()}.tmp"
            with open(draft, "wb") as f:
                f.write(build_chunk(payloads))
            os.replace(draft, final)
        return Written(len(by))


class ChunkSource(DataSource):
    """format("lodestrata_chunks"): chunk images in a folder, a file each; rows (cz, cy, cx, k, payload)."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_chunks"

    def schema(self) -> str:
        return CHUNK_ROWS

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options)
