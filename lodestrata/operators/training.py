"""Priors of the coefficient coder from tallies, and the search over rate and distortion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import transform

#: Fixed values of the format: the chance of a 0 in each context, of 2048: eight of significance, eight of more to come, sixteen of magnitude.
PRIORS = (
    164, 752, 1333, 1625, 1807, 1933, 1990, 1733,
    1, 1, 3, 4, 13, 80, 1347, 2047,
    1042, 713, 866, 972, 1041, 1086, 1104, 1069,
    959, 873, 852, 995, 1316, 1891, 2047, 1024,
)
ONE, EVEN, BUCKETS, MAGNITUDES = 2048, 1024, 8, 16
#: The last place of a piece that has none set, and the columns of a piece after its block.
NONE, PIECE = -(1 << 40), ("last", "done", "here", "scan", "bucket")


def priors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PRIORS)), "ctx int, p0 int")


def _digits(sizes: np.ndarray) -> np.ndarray:
    """The binary digits of magnitudes less one: the lengths of their unary prefixes."""
    return np.searchsorted(1 << np.arange(63, dtype=np.int64), sizes - 1, side="right")


def tally(indexed: DataFrame, block: list[str]) -> DataFrame:
    """(ctx, n0, n1) over blocks of (block, scan, bucket, idx): the bits that coding them would put in each context.

    Bits end after a block's last index that isn't 0; a block without one has a bit for every place. An index that is null
    counts as 0; rows without a scan place or a bucket hold no bits.

    What comes together of a block in a batch is counted there, but for the places that depend on the block's last
    index: only these go to their block, packed, so that neither they nor a task's memory grow to a sort of all places.
    """
    kinds = [indexed.schema[c].dataType.simpleString() for c in block]
    kept, nb = ", ".join(f"`{c}` {k}" for c, k in zip(block, kinds, strict=True)), len(block)
    rows = indexed.where("scan IS NOT NULL AND bucket IS NOT NULL").select(*block, F.col("scan").cast("int").alias("scan"), F.col("bucket").cast("int").alias("bucket"), F.coalesce(F.col("idx").cast("long"), F.lit(0).cast("long")).alias("idx"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece: the last place set, the buckets set there, the places and buckets of zeros past it; with a batch's first, the counts of all else."""
        for b in batches:
            if not b.num_rows:
                continue
            code = transform._codes(b, nb)
            order = np.argsort(code, kind="stable")
            scan, bucket, idx = (b.column(nb + i).to_numpy()[order] for i in range(3))
            change = np.diff(code[order], prepend=-1) != 0
            starts, of = np.flatnonzero(change), np.cumsum(change) - 1
            some = idx != 0
            last = np.maximum.reduceat(np.where(some, scan.astype(np.int64), NONE), starts)
            sure, here = scan < last[of], some & (scan == last[of])
            k = _digits(np.abs(idx[some]))
            unary = np.arange(k.max(initial=0) + 1)
            found = [(bucket[some], 1), (bucket[some & sure] + BUCKETS, 1), (bucket[~some & ~(scan > last[of])], 0), (np.minimum(k, MAGNITUDES - 1) + 2 * BUCKETS, 0)]
            done = [(c, n, bit) for at, bit in found for c, n in zip(*np.unique(at, return_counts=True), strict=True)]
            done += [(min(i, MAGNITUDES - 1) + 2 * BUCKETS, n, 1) for i, n in zip(unary, (k[:, None] > unary).sum(axis=0) if len(k) else [0], strict=True) if n]
            left = ~some & (scan > last[of])
            ends = lambda m: np.append(0, np.cumsum(np.add.reduceat(m.astype(np.int64), starts)))
            first = pa.array(order[starts])
            counts = np.array(done, np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(first) for c in range(nb)), pa.array(last), transform._binary(counts, np.append(0, np.full(len(starts), len(counts)))),
                 transform._binary(bucket[here], ends(here)), transform._binary(scan[left], ends(left)), transform._binary(bucket[left].astype(np.int32), ends(left))],
                [*block, *PIECE],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def add(at: np.ndarray, bit: int) -> None:
            for c, n in zip(*np.unique(at, return_counts=True), strict=True):
                sums[int(c), bit] += int(n)

        def settle(last: int, places: list, zeros: list) -> None:
            """Counts a block's places, of whose pieces the last places and the buckets there and the zeros past them are given."""
            for at, buckets in places:
                add(buckets + BUCKETS, int(at < last))
            scan, bucket = (np.concatenate(x) for x in zip(*zeros, strict=True))
            add(bucket if last == NONE else bucket[scan <= last], 0)

        now = None
        for b in batches:
            columns = [b.column(nb + i) for i in range(len(PIECE))]
            keys = zip(*(b.column(c).to_pylist() for c in range(nb)), strict=True) if nb else [()] * b.num_rows
            for i, key in enumerate(keys):
                at, (done, here, scan, bucket) = columns[0][i].as_py(), (np.frombuffer(c[i].as_py(), t) for c, t in zip(columns[1:], ("<i8", "<i4", "<i4", "<i4"), strict=True))
                for c, n, bit in done.reshape(-1, 3).tolist():
                    sums[c, bit] += n
                if now is not None and key != now[0]:
                    settle(*now[1:])
                    now = None
                now = now or [key, NONE, [], []]
                now[1] = max(now[1], at)
                now[2].append((at, here))
                now[3].append((scan, bucket))
        if now is not None:
            settle(*now[1:])
        found = sorted({c for c, _ in sums})
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array([sums[c, bit] for c in found], pa.int64()) for bit in (0, 1))], ["ctx", "n0", "n1"])

    pieces = rows.mapInArrow(pack, f"{kept}, last long, done binary, here binary, scan binary, bucket binary")
    counts = transform.gathered(pieces, indexed, block).mapInArrow(count, "ctx int, n0 long, n1 long")
    return counts.groupBy("ctx").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fitted(tallies: DataFrame) -> DataFrame:
    """(ctx, p0): the tallied chances, rounded and held to 1 to 2047; contexts without a bit keep their prior."""
    n = F.col("n0") + F.col("n1")
    p = F.least(F.greatest(F.floor((F.col("n0") * ONE + F.floor(n / 2)) / n), F.lit(1)), F.lit(ONE - 1)).cast("int")
    base = priors(tallies.sparkSession)
    return base.join(F.broadcast(tallies), "ctx", "left").select("ctx", F.when(n > 0, p).otherwise(F.col("p0")).alias("p0"))


def strided(rows: DataFrame, axes: list[str], every: int) -> DataFrame:
    """Every so many-th block along each axis."""
    keep = F.lit(True)
    for a in axes:
        keep = keep & (F.col(a) % every == 0)
    return rows.where(keep)


def psnr_at(curve: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate, psnr): a curve's (by, ratio, psnr) at given rates, straight between its points and level beyond its ends."""
    w = Window.partitionBy(*by).orderBy("ratio")
    ends = Window.partitionBy(*by)
    spans = curve.select(*by, "ratio", "psnr", F.lead("ratio").over(w).alias("next"), F.lead("psnr").over(w).alias("to"), F.min("ratio").over(ends).alias("least"))
    at = F.col("rate")
    hit = spans.join(F.broadcast(rates), (at >= F.col("ratio")) & ((at < F.col("next")) | F.col("next").isNull()) | (at < F.col("least")) & (F.col("ratio") == F.col("least")))
    share = F.greatest(F.lit(0.0), (at - F.col("ratio")) / (F.col("next") - F.col("ratio")))
    value = F.when(F.col("next").isNull() | (at <= F.col("ratio")), F.col("psnr")).otherwise(F.col("psnr") + share * (F.col("to") - F.col("psnr")))
    return hit.select(*by, "rate", value.alias("psnr"))


def gain(curves: DataFrame, rates: DataFrame, base: str, name: str = "candidate") -> DataFrame:
    """(candidate, gain): the mean lead in PSNR of each curve over the one named base."""
    all_at = psnr_at(curves, rates, [name])
    ref = all_at.where(F.col(name) == base).select("rate", F.col("psnr").alias("ref"))
    return all_at.join(F.broadcast(ref), "rate").groupBy(name).agg(F.avg(F.col("psnr") - F.col("ref")).alias("gain"))


def best(scored: DataFrame, score: str) -> DataFrame:
    """The row with the largest score, ties to the smallest row by its other columns."""
    return scored.orderBy(F.desc(score), *[c for c in scored.columns if c != score]).limit(1)
