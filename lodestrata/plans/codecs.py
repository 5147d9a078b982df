"""Queries: the range coder, coefficient and mask coding, blocks, colour tiles and surfaces; decoded results against originals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from lodestrata.operators import codec, entropy

from . import fixtures as fx
from .transforms import IDX2, idx2

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("codec_presets", "SELECT * FROM (VALUES ('volume',16,3,1,false),('gray',64,2,1,false),('rgb',64,2,3,true),('surface',64,2,3,false)) t(name, side, rank, channels, colour)")
def codec_presets(spark, sf_dir):
    return spark.createDataFrame([(k, p.n, p.rank, p.channels, p.colour) for k, p in codec.PRESETS.items()], "name string, side int, rank int, channels int, colour boolean")


@query("range_coder_roundtrip", "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
def range_coder_roundtrip(spark, sf_dir):
    """Every conversation's text as bits, coded and decoded."""

    @F.arrow_udf("binary")
    def through(texts: pa.Array) -> pa.Array:
        whole = texts.cast(pa.binary()).to_pylist()
        sizes = np.array([len(t) for t in whole])
        out: list[bytes] = [b""] * len(whole)
        ranks = np.argsort(sizes, kind="stable")
        for at in np.array_split(ranks, -(-len(ranks) // codec.LANES)):
            long = int(sizes[at].max())
            bits = np.unpackbits(np.stack([np.frombuffer(whole[i].ljust(long, b"\0"), np.uint8) for i in at]), axis=1)
            back = np.packbits(entropy.decode_bit_rows(entropy.encode_bit_rows(bits), 8 * long), axis=1)
            for i, row in zip(at, back, strict=True):
                out[i] = row[: sizes[i]].tobytes()
        return pa.array(out, pa.binary())

    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(through("text"), 256).alias("digest"))


@query("range_coder_skew", "SELECT part, true AS under FROM (SELECT DISTINCT conv_id % 4 AS part FROM conversations)")
def range_coder_skew(spark, sf_dir):
    """Bits of which one in ten is set take under 0.8 bits each."""
    parts = fx.table(spark, sf_dir, "conversations").select((F.col("conv_id") % 4).alias("part")).distinct()

    @F.arrow_udf("boolean")
    def under(part: pa.Array) -> pa.Array:
        bits = np.stack([np.random.default_rng(p).random(20_000) < 0.1 for p in part.to_pylist()])
        return pa.array([len(b) * 8 / 20_000 < 0.8 for b in entropy.encode_bit_rows(bits)])

    return parts.select("part", under("part").alias("under"))


def tile_rows(spark, sf_dir):
    return fx.tile(spark, sf_dir).select("tile", (F.col("v") * 64 + F.col("u")).cast("int").alias("lin"), "val")


@query("coefficients_roundtrip", f"SELECT tile, CAST(v * 64 + u AS INT) AS lin, idx FROM ({IDX2}) WHERE idx <> 0")
def coefficients_roundtrip(spark, sf_dir):
    def make(dense):
        back = entropy.decode_index_rows(entropy.encode_index_rows(dense, 64, 2), 64, 2)
        which, lin = np.nonzero(back)
        return which, [lin, back[which, lin]]

    rows = idx2(spark, sf_dir).select("tile", (F.col("v") * 64 + F.col("u")).cast("int").alias("lin"), F.col("idx").alias("val"))
    return codec.per_block(rows, ["tile"], 4096, make, "tile long, lin int, idx int")


@query("block_indices", f"SELECT tile, count(*) AS nonzero, CAST(sum(abs(idx)) AS BIGINT) AS total FROM ({IDX2}) WHERE idx <> 0 GROUP BY tile")
def block_indices(spark, sf_dir):
    """Indices read back from whole coded blocks, against those of the relational transform."""

    def make(dense):
        idx = entropy.decode_index_rows(codec.encode_many(dense.reshape(-1, 64, 64), 1.0, 2), 64, 2)
        return np.arange(len(idx)), [(idx != 0).sum(axis=1), np.abs(idx).sum(axis=1)]

    return codec.per_block(tile_rows(spark, sf_dir), ["tile"], 4096, make, "tile long, nonzero long, total long")


@query("block_quality", "SELECT DISTINCT vec_id // 64 AS tile, true AS psnr_ok, true AS smaller FROM embeddings")
def block_quality(spark, sf_dir):
    def make(dense):
        data = codec.encode_many(dense.reshape(-1, 64, 64), 1.0, 2)
        mse = ((codec.decode_many(data, 1.0, 64, 2).reshape(dense.shape) - dense) ** 2).mean(axis=1)
        return np.arange(len(dense)), [mse <= 255**2 / 10**2.8, [len(d) < 4096 * 4 for d in data]]

    return codec.per_block(tile_rows(spark, sf_dir), ["tile"], 4096, make, "tile long, psnr_ok boolean, smaller boolean")


SMALL = fx.VOX


def small_blocks(spark, sf_dir):
    from lodestrata.functions.keys import voxel_address

    a = voxel_address(F.col("z"), F.col("y"), F.col("x"))
    rows = fx.vox(spark, sf_dir)
    return rows.select(*[c.alias(n) for n, c in a.items()], F.col("v").cast("double").alias("val"))


def voxels_of(decoded):
    """(z, y, x, v) of decoded blocks, without air."""
    out = decoded.select("bz", "by", "bx", F.posexplode("vox").alias("lin", "v")).where("v <> 0")
    z, y, x = F.floor(F.col("lin") / 256), F.floor(F.col("lin") / 16) % 16, F.col("lin") % 16
    return out.select((F.col("bz") * 16 + z).cast("int").alias("z"), (F.col("by") * 16 + y).cast("int").alias("y"), (F.col("bx") * 16 + x).cast("int").alias("x"), "v")


@query("mask_roundtrip", f"SELECT z, y, x FROM ({SMALL})")
def mask_roundtrip(spark, sf_dir):
    """Which cells are material survives lossy coding exactly."""
    coded = codec.encode_blocks(small_blocks(spark, sf_dir), ["bz", "by", "bx"], 4.0)
    return voxels_of(codec.decode_blocks(coded, 4.0)).select("z", "y", "x")


@query("masked_quality", "SELECT true AS floor_ok, true AS psnr_ok")
def masked_quality(spark, sf_dir):
    coded = codec.encode_blocks(small_blocks(spark, sf_dir), ["bz", "by", "bx"], 2.0)
    back = voxels_of(codec.decode_blocks(coded, 2.0)).withColumnRenamed("v", "b")
    both = fx.vox(spark, sf_dir).join(back, ["z", "y", "x"])
    mse = F.avg((F.col("v") - F.col("b")) * (F.col("v") - F.col("b")))
    return both.agg((F.min("b") >= codec.FLOOR).alias("floor_ok"), (10 * F.log10(F.lit(65025.0) / mse) >= 28).alias("psnr_ok"))


@query("air_fill", f"SELECT z // 16 AS bz, y // 16 AS \"by\", x // 16 AS bx, true AS kept, true AS within FROM ({SMALL}) GROUP BY 1, 2, 3")
def air_fill(spark, sf_dir):
    """Relaxation leaves material as it is and air near its bounds."""

    def make(dense):
        kept, within = [], []
        for block in dense.reshape(-1, 16, 16, 16):
            out, mask, val = codec.air_fill(block, block != 0), block != 0, block[block != 0]
            reach = np.ptp(val) + 1
            kept.append(bool((out[mask] == val).all()))
            within.append(bool(out.min() > val.min() - reach and out.max() < val.max() + reach))
        return np.arange(len(dense)), [kept, within]

    return codec.per_block(small_blocks(spark, sf_dir), ["bz", "by", "bx"], 4096, make, "bz int, by int, bx int, kept boolean, within boolean")


@query("rgb_quality", "SELECT DISTINCT CAST(p_partkey // 4096 AS BIGINT) AS tile, true AS ok FROM part")
def rgb_quality(spark, sf_dir):
    rows = fx.rgb(spark, sf_dir).select(F.floor(F.col("p_partkey") / 4096).alias("tile"), (F.col("p_partkey") % 4096).cast("int").alias("lin"), (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("double").alias("val"))

    def make(dense):
        v, p = dense.astype(np.int64), codec.PRESETS["rgb"]
        planes = np.stack([v >> 16, v >> 8 & 255, v & 255], axis=1).reshape(-1, 3, 64, 64).astype(float)
        back = codec.decode_tiles(codec.encode_tiles(planes, 6.0, p), 6.0, p)
        return np.arange(len(v)), [((back - planes) ** 2).mean(axis=(1, 2, 3)) <= 255**2 / 10**1.8]

    return codec.per_block(rows, ["tile"], 4096, make, "tile long, ok boolean")


@query("garbage_decode", "SELECT page_id, true AS finite FROM pages")
def garbage_decode(spark, sf_dir):
    """Raw pages as payloads: decoding never fails."""

    @F.arrow_udf("boolean")
    def finite(pages: pa.Array) -> pa.Array:
        whole, out = pages.cast(pa.binary()).to_pylist(), []
        for at in range(0, len(whole), codec.LANES):
            some = whole[at : at + codec.LANES]
            masked, tiles = codec.decode_masked_many(some, 2.0, 16, 3), codec.decode_tiles(some, 2.0, codec.PRESETS["rgb"])
            out.append(np.isfinite(masked).all(axis=(1, 2, 3)) & np.isfinite(tiles).all(axis=(1, 2, 3)))
        return pa.array(np.concatenate(out) if out else [], pa.bool_())

    return fx.table(spark, sf_dir, "pages").select("page_id", finite("html").alias("finite"))
