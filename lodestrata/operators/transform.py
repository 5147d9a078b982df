"""The separable cosine transform of blocks gathered whole, band-weighted quantisation of its coefficients, and scan orders."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import quant

BUCKETS = 8
#: Places of blocks transformed at once.
AT_ONCE = 1 << 16
#: Bytes of input files for each task that gathers blocks: their packed samples are two or three times as many.
TASK_INPUT = 16 << 20


def matrix(n: int) -> np.ndarray:
    """The orthonormal DCT-II matrix: row k, column i."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.where(k == 0, math.sqrt(1 / n), math.sqrt(2 / n)) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))


def basis(spark: SparkSession, n: int) -> DataFrame:
    """(k, i, c): the same as n * n rows."""
    at = spark.range(n * n)
    k, i = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    c = F.when(k == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n)) * F.cos(F.lit(math.pi) * (2 * i + 1) * k / (2.0 * n))
    return at.select(k.alias("k"), i.alias("i"), c.alias("c"))


def _packed(rows: DataFrame, block: list[str], axes: list[str], n: int) -> DataFrame:
    """(block, at, val): the samples of a block that come together in a batch as one row of places and values in binary.

    A place is the linear index in the block; -1 less it stands for a sample that is null. Rows of a block are next to one another.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in block]
    inside = [F.col(a).between(0, n - 1) for a in axes]
    lin = sum((F.col(a).cast("long") * n ** (len(axes) - 1 - i) for i, a in enumerate(axes)), F.lit(0).cast("long"))
    flat = rows.where(reduce(Column.__and__, inside)).select(*block, lin.alias("at"), F.col("val").cast("double").alias("val"))
    place = _place(n ** len(axes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = _codes(b, len(block))
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            val, at = b.column(len(block) + 1), b.column(len(block)).to_numpy()
            none = val.is_null().to_numpy(zero_copy_only=False)
            val = np.where(none, 0.0, val.to_numpy(zero_copy_only=False))[order]
            at = np.where(none, -1 - at, at)[order].astype(place)
            first, ends = pa.array(order[starts]), np.append(starts, len(order))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(first) for c in range(len(block))), _binary(at, ends), _binary(val, ends)], [*block, "at", "val"])

    kept = ", ".join(f"`{c}` {k}" for c, k in zip(block, kinds, strict=True))
    return gathered(flat.mapInArrow(pack, f"{kept}, at binary, val binary"), rows, block)


def gathered(pieces: DataFrame, source: DataFrame, block: list[str]) -> DataFrame:
    """pieces with those of a block next to one another, in so many tasks that each holds about as much whatever the size of source, which pieces are of.

    Where the session's number of partitions will do, or source's size isn't known, Spark chooses.
    """
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    tasks, usual = -(-size // TASK_INPUT), int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fixed = [tasks] if usual < tasks < 1 << 20 else []
    return pieces.repartition(*fixed, *block).sortWithinPartitions(*block)


def _place(size: int) -> str:
    return "<i2" if size < 1 << 15 else "<i4"


def _codes(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """A number for each row that is equal where the first columns are; null equals null."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in range(columns):
        found = batch.column(c).dictionary_encode(null_encoding="encode")
        code = code * len(found.dictionary) + found.indices.to_numpy()
    return code


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary rows of the values between one end and the next."""
    off = (ends * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, dtype: str) -> np.ndarray:
    """The values of all binary rows in a row."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view(dtype)


def _turned(rows: DataFrame, block: list[str], axes: list[str], n: int, turns: list[np.ndarray], held: bool = False) -> DataFrame:
    """(block, axes, val): each block multiplied along every axis with the matrices of turns one after the other.

    Samples go to their block once, packed, and a task has AT_ONCE places in arrays at a time and no table of sums: memory
    doesn't grow with the rows. All places of a block come back, or with held those that rows has. Samples at one
    place add up, those off the block are left out, and a block of nulls alone stays null.
    """
    rank, size = len(axes), n ** len(axes)
    place, some, nb = _place(size), max(1, AT_ONCE // size), len(block)
    where = np.stack(np.unravel_index(np.arange(size), (n,) * rank)).astype(np.int32)

    def made(keys: list[pa.Array], x: np.ndarray, here: np.ndarray, real: np.ndarray) -> pa.RecordBatch:
        full = x.reshape(-1, *(n,) * rank)
        for m in turns:
            for axis in range(1, rank + 1):
                full = np.moveaxis(np.moveaxis(full, axis, -1) @ m.T, -1, axis)
        val, of = full.reshape(-1), np.repeat(np.arange(len(x)), size)
        null, spots = ~np.repeat(real, size), np.tile(where, len(x))
        if held:
            chosen = here.reshape(-1)
            val, of, null, spots = val[chosen], of[chosen], null[chosen], spots[:, chosen]
        columns = [k.take(pa.array(of)) for k in keys]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, spots), pa.array(val, pa.float64(), mask=null)], [*block, *axes, "val"])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the keys, sums, places and whether any is real of the block that may go on
        for b in batches:
            if not b.num_rows:
                continue
            change = np.diff(_codes(b, nb), prepend=-1) != 0
            starts = np.flatnonzero(change)
            for g in range(0, len(starts), some):
                lo, hi = int(starts[g]), int(starts[g + some]) if g + some < len(starts) else b.num_rows
                part = b.slice(lo, hi - lo)
                first = pa.array(starts[g : g + some] - lo)
                keys, count = [part.column(c).take(first) for c in range(nb)], len(first)
                at, val = _values(part.column(nb), place).astype(np.int64), _values(part.column(nb + 1), "<f8")
                length = np.diff(np.frombuffer(part.column(nb).buffers()[1], np.int32)[part.column(nb).offset :][: len(part.column(nb)) + 1]) // np.dtype(place).itemsize
                of = np.repeat(np.cumsum(change[lo:hi]) - 1, length)
                none = at < 0
                spot = of * size + np.where(none, -1 - at, at)
                x = np.bincount(spot, weights=val, minlength=count * size).reshape(count, size)
                here = np.bincount(spot, minlength=count * size).reshape(count, size) > 0
                real = np.bincount(of[~none], minlength=count) > 0
                if last is not None:
                    if [k[0].as_py() for k in keys] == [k[0].as_py() for k in last[0]]:
                        x[0], here[0], real[0] = x[0] + last[1][0], here[0] | last[2][0], real[0] | last[3][0]
                    else:
                        yield made(*last)
                if count > 1:
                    yield made([k.slice(0, count - 1) for k in keys], x[:-1], here[:-1], real[:-1])
                last = [k.slice(count - 1) for k in keys], x[-1:], here[-1:], real[-1:]
        if last is not None:
            yield made(*last)

    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in block] + [f"`{a}` int" for a in axes]
    return _packed(rows, block, axes, n).mapInArrow(turn, ", ".join([*kept, "val double"]))


def forward(rows: DataFrame, block: list[str], axes: list[str], n: int) -> DataFrame:
    """Coefficients (block, axes as frequencies, val) of samples (block, axes, val); absent samples are 0."""
    return _turned(rows, block, axes, n, [matrix(n)])


def inverse(rows: DataFrame, block: list[str], axes: list[str], n: int) -> DataFrame:
    """Samples of coefficients; absent ones are 0."""
    return _turned(rows, block, axes, n, [matrix(n).T])


def there_and_back(rows: DataFrame, block: list[str], axes: list[str], n: int) -> DataFrame:
    """The samples of the coefficients of samples, at the places that rows has. A block's samples meet once for both ways."""
    return _turned(rows, block, axes, n, [matrix(n), matrix(n).T], held=True)


def band(axes: list[str]) -> Column:
    """The sum of a coefficient's frequencies."""
    return sum((F.col(a) for a in axes[1:]), F.col(axes[0])).cast("int")


def bucket(band: Column, top: int) -> Column:
    """The context bucket of a band: one of eight equal shares."""
    return F.floor(band * BUCKETS / F.lit(top + 1)).cast("int") if top > 0 else F.lit(0)


def steps(spark: SparkSession, q: float, n: int, rank: int) -> DataFrame:
    """(band, step, bucket) of every band."""
    top = quant.max_band(n, rank)
    b = F.col("band")
    return spark.range(top + 1).select(F.col("id").cast("int").alias("band")).select("band", quant.step(b, F.lit(float(q)), top).alias("step"), bucket(b, top).alias("bucket"))


def quantized(coefs: DataFrame, axes: list[str], n: int, q: float) -> DataFrame:
    """Adds band, step and idx."""
    top = quant.max_band(n, len(axes))
    out = coefs.withColumn("band", band(axes))
    out = out.withColumn("step", quant.step(F.col("band"), F.lit(float(q)), top))
    return out.withColumn("idx", quant.quantize(F.col("val"), F.col("step")))


def scan(spark: SparkSession, n: int, rank: int) -> DataFrame:
    """(lin, band, scan): places of a block by band, then linear index. A block has 4096 of them at most."""
    lin = F.col("id")
    digits = sum(((F.floor(lin / n**a) % n) for a in range(rank)), F.lit(0)).cast("int")
    rows = spark.range(n**rank).select(lin.cast("int").alias("lin"), digits.alias("band"))
    before = F.sum("size").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("band").agg(F.count("*").alias("size")).withColumn("start", F.coalesce(before, F.lit(0)))
    within = F.row_number().over(Window.partitionBy("band").orderBy("lin")) - 1
    return rows.withColumn("within", within).join(F.broadcast(starts), "band").select("lin", "band", (F.col("start") + F.col("within")).cast("int").alias("scan"))


def last_nonzero(indexed: DataFrame, block: list[str]) -> DataFrame:
    """(block, last): the last scan place with an index that isn't 0; -1 without one."""
    return indexed.groupBy(*block).agg(F.coalesce(F.max(F.when(F.col("idx") != 0, F.col("scan"))), F.lit(-1)).alias("last"))


def corrections(rows: DataFrame, tau: float, a: str = "a", b: str = "b") -> DataFrame:
    """The rows whose error is over tau, with delta, which mends b."""
    return rows.withColumn("delta", F.col(a) - F.col(b)).where(F.abs("delta") > tau)


def corrected(rows: DataFrame, deltas: DataFrame, key: list[str], b: str = "b") -> DataFrame:
    """rows with the deltas added; deltas for no row are ignored."""
    return rows.join(deltas.select(*key, "delta"), key, "left").withColumn(b, F.col(b) + F.coalesce("delta", F.lit(0.0))).drop("delta")
