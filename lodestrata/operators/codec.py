"""Lossy block coding: transform, quantisation and entropy coding of blocks, masked blocks and multi-channel tiles."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import quant
from lodestrata.operators import entropy, transform

#: What decoded material is at least, relaxation factor and sweeps of the air fill.
FLOOR, OMEGA, SWEEPS = 1.0, 1.6, 8
#: Blocks that a task codes side by side; a batch of them takes some 32 MB for each array of 4096 numbers a block.
LANES = 1024


@dataclass(frozen=True)
class Preset:
    """A codec: block side, rank, channels and whether channels are colours."""

    n: int
    rank: int
    channels: int = 1
    colour: bool = False

    @property
    def total(self) -> int:
        return self.n**self.rank


PRESETS = {"volume": Preset(16, 3), "gray": Preset(64, 2), "rgb": Preset(64, 2, 3, True), "surface": Preset(64, 2, 3)}


@lru_cache
def _steps(n: int, rank: int) -> np.ndarray:
    """Steps at quality 1 for every place of a block."""
    band = sum(np.indices((n,) * rank))
    return 1 + quant.GAIN * (band / (rank * (n - 1))) ** quant.EXPONENT


def _turn(blocks: np.ndarray, m: np.ndarray, rank: int) -> np.ndarray:
    for axis in range(blocks.ndim - rank, blocks.ndim):
        blocks = np.moveaxis(np.tensordot(m, blocks, axes=(1, axis)), 0, axis)
    return blocks


def forward(blocks: np.ndarray, rank: int | None = None) -> np.ndarray:
    """Coefficients of a block, or of many along the axes before the last rank ones."""
    return _turn(blocks, transform.matrix(blocks.shape[-1]), rank or blocks.ndim)


def inverse(blocks: np.ndarray, rank: int | None = None) -> np.ndarray:
    return _turn(blocks, transform.matrix(blocks.shape[-1]).T, rank or blocks.ndim)


def quantize(c: np.ndarray, q: float, rank: int | None = None) -> np.ndarray:
    step = q * _steps(c.shape[-1], rank or c.ndim)
    t = np.abs(c) / step
    return np.where(t < quant.DEAD_ZONE, 0, np.sign(c) * np.floor(t - quant.DEAD_ZONE + 1)).astype(np.int64)


def dequantize(index: np.ndarray, q: float, rank: int | None = None) -> np.ndarray:
    step = q * _steps(index.shape[-1], rank or index.ndim)
    return np.where(index == 0, 0.0, np.sign(index) * (np.abs(index) - 1 + quant.DEAD_ZONE + quant.RECON) * step)


def encode_block(block: np.ndarray, q: float) -> bytes:
    return encode_many(block[None], q, block.ndim)[0]


def encode_many(blocks: np.ndarray, q: float, rank: int) -> list[bytes]:
    """encode_block of each of blocks, along the first axis."""
    clean = np.nan_to_num(blocks, nan=0.0, posinf=0.0, neginf=0.0)
    return entropy.encode_index_rows(quantize(forward(clean, rank), q, rank), blocks.shape[-1], rank)


def decode_block(data: bytes, q: float, n: int, rank: int) -> np.ndarray:
    return decode_many([data], q, n, rank)[0]


def decode_many(data: list[bytes], q: float, n: int, rank: int) -> np.ndarray:
    """decode_block of each, along the first axis."""
    return inverse(dequantize(entropy.decode_index_rows(data, n, rank).reshape((-1,) + (n,) * rank), q, rank), rank)


def air_fill(block: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The block with air relaxed towards the mean of its neighbours, from the mean of the material on; material stays.

    Places of one parity depend on the other's alone, so each half sweep is one array expression.
    """
    if not mask.any() or mask.all():
        return block if mask.all() else np.zeros_like(block)
    out = np.where(mask, block, block[mask].mean())
    parity = sum(np.indices(block.shape)) % 2
    count = sum(np.where((np.indices(block.shape)[a] > 0), 1, 0) + np.where(np.indices(block.shape)[a] < block.shape[a] - 1, 1, 0) for a in range(block.ndim))
    for _ in range(SWEEPS):
        for colour in (0, 1):
            total = np.zeros_like(out)
            for a in range(out.ndim):
                near, far = [slice(None)] * out.ndim, [slice(None)] * out.ndim
                near[a], far[a] = slice(None, -1), slice(1, None)
                total[tuple(far)] += out[tuple(near)]
                total[tuple(near)] += out[tuple(far)]
            here = ~mask & (parity == colour)
            out = np.where(here, out + OMEGA * (total / count - out), out)
    return out


def encode_masked(block: np.ndarray, mask: np.ndarray, q: float) -> bytes:
    """Length and bytes of the mask, then of the coefficients of the air-filled block."""
    return encode_masked_many(block[None], mask[None], q)[0]


def encode_masked_many(blocks: np.ndarray, masks: np.ndarray, q: float) -> list[bytes]:
    """encode_masked of each of blocks, along the first axis."""
    bits = entropy.encode_bit_rows(masks.reshape(len(masks), -1))
    filled = np.stack([air_fill(b, m) for b, m in zip(blocks, masks, strict=True)])
    coefs = encode_many(filled, q, blocks.ndim - 1)
    return [struct.pack("<I", len(b)) + b + struct.pack("<I", len(c)) + c for b, c in zip(bits, coefs, strict=True)]


def frames(data: bytes, n: int) -> list[bytes] | None:
    """n length-prefixed parts; None if the data doesn't hold them."""
    out, at = [], 0
    for _ in range(n):
        if at + 4 > len(data):
            return None
        size = struct.unpack_from("<I", data, at)[0]
        at += 4
        if at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
    return out


def decode_masked(data: bytes, q: float, n: int, rank: int) -> np.ndarray:
    """Air is exactly 0 and material FLOOR at least; what isn't framed right is all air."""
    return decode_masked_many([data], q, n, rank)[0]


def decode_masked_many(data: list[bytes], q: float, n: int, rank: int) -> np.ndarray:
    """decode_masked of each, along the first axis."""
    out = np.zeros((len(data),) + (n,) * rank)
    framed = [(i, parts) for i, parts in enumerate(frames(d, 2) for d in data) if parts is not None]
    if framed:
        at = [i for i, _ in framed]
        mask = entropy.decode_bit_rows([p[0] for _, p in framed], n**rank).reshape((-1,) + (n,) * rank)
        out[at] = np.where(mask, np.maximum(decode_many([p[1] for _, p in framed], q, n, rank), FLOOR), 0.0)
    return out


def encode_tile(planes: np.ndarray, q: float, preset: Preset) -> bytes:
    """Channels (c, n, n), each length-prefixed; colours are turned to luma and differences first."""
    return encode_tiles(planes[None], q, preset)[0]


def encode_tiles(tiles: np.ndarray, q: float, preset: Preset) -> list[bytes]:
    """encode_tile of each of tiles, along the first axis."""
    if preset.colour:
        r, g, b = np.moveaxis(tiles, 1, 0)
        co = r - b
        t = b + co / 2
        cg = g - t
        tiles = np.stack([t + cg / 2, co, cg], axis=1)
    coded = encode_many(tiles.reshape((-1,) + (preset.n,) * preset.rank), q, preset.rank)
    framed = [struct.pack("<I", len(c)) + c for c in coded]
    return [b"".join(framed[i : i + preset.channels]) for i in range(0, len(framed), preset.channels)]


def decode_tile(data: bytes, q: float, preset: Preset) -> np.ndarray:
    """The channels again; zeros for data that isn't framed right."""
    return decode_tiles([data], q, preset)[0]


def decode_tiles(data: list[bytes], q: float, preset: Preset) -> np.ndarray:
    """decode_tile of each, along the first axis."""
    out = np.zeros((len(data), preset.channels) + (preset.n,) * preset.rank)
    framed = [(i, parts) for i, parts in enumerate(frames(d, preset.channels) for d in data) if parts is not None]
    if not framed:
        return out
    tiles = decode_many([p for _, parts in framed for p in parts], q, preset.n, preset.rank).reshape((len(framed),) + out.shape[1:])
    if preset.colour:
        y, co, cg = np.moveaxis(tiles, 1, 0)
        t = y - cg / 2
        b = t - co / 2
        tiles = np.stack([b + co, cg + t, b], axis=1)
    out[[i for i, _ in framed]] = tiles
    return out


def dense_blocks(batches: Iterator[pa.RecordBatch], block: list[str], total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, blocks) of rows (block, lin, val) sorted by block, at most LANES blocks a time (fewer of over 4096 places), 0 where no row is."""
    lanes = max(1, LANES * 4096 // max(total, 4096))
    keys, dense, held = np.zeros((lanes, len(block)), np.int64), np.zeros((lanes, total)), 0
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in block], axis=1).astype(np.int64)
        lin, val = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lin", "val"))
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]).any(axis=1)
        new[0] = not held or (at[0] != keys[held - 1]).any()
        lane = held - 1 + np.cumsum(new)
        start = 0
        while start < len(at):
            stop = int(np.searchsorted(lane, lanes))
            keys[lane[start:stop]], dense[lane[start:stop], lin[start:stop]] = at[start:stop], val[start:stop]
            if stop > start:
                held = int(lane[stop - 1]) + 1
            if stop < len(at):
                yield keys[:held].copy(), dense[:held]
                dense[:], lane, held = 0, lane - lanes, 0
            start = stop
    if held:
        yield keys[:held].copy(), dense[:held]


Made = tuple[np.ndarray, list]


def per_block(rows: DataFrame, block: list[str], total: int, make: Callable[[np.ndarray], Made], schema: str) -> DataFrame:
    """Rows that make gives for the blocks of (block, lin, val) rows, many blocks a call.

    make takes an array (blocks, total) and returns the place of the block of each of its rows and its columns. A block's
    columns are whole numbers, none null, and schema names them first. Blocks are dealt over tasks and held LANES at a time.
    """
    kinds = _arrow(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, dense in dense_blocks(batches, block, total):
            which, columns = make(dense)
            every = [*keys[which].T, *columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(every, kinds, strict=True)], schema=kinds)

    return rows.select(*block, "lin", "val").repartition(*block).sortWithinPartitions(*block).mapInArrow(of, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in schema.split(","))])


def encode_blocks(rows: DataFrame, block: list[str], q: float, n: int = 16, rank: int = 3) -> DataFrame:
    """(block, payload) of sparse blocks (block, lin, val): masked and coded. Blocks without material don't come up."""

    def make(dense: np.ndarray) -> Made:
        which = np.flatnonzero((dense != 0).any(axis=1))
        some = dense[which].reshape((-1,) + (n,) * rank)
        return which, [encode_masked_many(some, some != 0, q) if which.size else []]

    kinds = dict(rows.dtypes)
    keys = ", ".join(f"{c} {'long' if kinds[c] == 'bigint' else kinds[c]}" for c in block)
    return per_block(rows, block, n**rank, make, f"{keys}, payload binary")


def decode_blocks(coded: DataFrame, q: float, n: int = 16, rank: int = 3) -> DataFrame:
    """coded with vox, the block's samples in linear order, in place of payload; null for null."""
    others = coded.drop("payload")
    total = n**rank

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, LANES):
                b = whole.slice(start, LANES)
                payloads = b.column("payload")
                there = payloads.is_valid().to_numpy(zero_copy_only=False)
                vox = decode_masked_many(payloads.drop_null().to_pylist(), q, n, rank).ravel()
                ends = np.concatenate([[0], np.cumsum(there) * total]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(vox), mask=pa.array(~there))
                names = [c for c in b.schema.names if c != "payload"]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists], names=[*names, "vox"])

    schema = others.withColumn("vox", F.lit(None).cast("array<double>")).schema
    return coded.select(*others.columns, "payload").mapInArrow(of, schema)
