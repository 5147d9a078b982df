"""Rewrites that let Catalyst prune: a box as predicates on chunks, blocks and voxels, and a surface as the blocks it can touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.keys import BLOCK, CHUNK, div
from lodestrata.operators import sampling


def box_predicate(low: tuple[int, int, int], size: tuple[int, int, int], chunk: int = CHUNK, block: int | None = BLOCK) -> Column:
    """Bounds on z, y, x and, derived from them, on the partition columns cz, cy, cx and the block columns bz, by, bx."""
    out = F.lit(all(n > 0 for n in size))
    for axis, a, n in zip("zyx", low, size, strict=True):
        last = a + n - 1
        out = out & F.col(f"c{axis}").between(a // chunk, last // chunk)
        if block:
            out = out & F.col(f"b{axis}").between(a // block, last // block)
        out = out & F.col(axis).between(a, last)
    return out


def surface_blocks(surface: DataFrame, steps: list[float], block: int = BLOCK) -> DataFrame:
    """(bz, by, bx): every block that a trilinear march of the surface can read, for a semi-join ahead of decoding."""
    at = sampling.corners(sampling.march(surface, steps), []).where("w > 0 AND cz >= 0 AND cy >= 0 AND cx >= 0")
    return at.select(*[div(F.col(f"c{a}"), block).alias(f"b{a}") for a in "zyx"]).distinct()
