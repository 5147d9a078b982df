"""Sample types: their registry, bit classes, and conversion to and from the working type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
LEAST_NORMAL_32, LEAST_NORMAL_64 = 1.1754943508222875e-38, 2.2250738585072014e-308
#: Classes of a floating point number.
ZERO, SUBNORMAL, NORMAL, INFINITE, NAN = "zero", "subnormal", "normal", "inf", "nan"


@dataclass(frozen=True)
class Sample:
    """A sample type: bytes, kind, bounds of what it stores, and the Spark type that holds it (none is unsigned there)."""

    name: str
    size: int
    is_float: bool
    is_signed: bool
    low: float
    high: float
    spark: str


def _integer(name: str, size: int, signed: bool, spark: str) -> Sample:
    top = 1 << (8 * size - signed)
    return Sample(name, size, False, signed, -top if signed else 0, top - 1, spark)


DTYPES = {
    d.name: d
    for d in (
        _integer("u8", 1, False, "smallint"),
        _integer("s8", 1, True, "tinyint"),
        _integer("u16", 2, False, "int"),
        _integer("s16", 2, True, "smallint"),
        _integer("u32", 4, False, "bigint"),
        _integer("s32", 4, True, "int"),
        Sample("f16", 2, True, True, -65504.0, 65504.0, "float"),
        Sample("f32", 4, True, True, -INF, INF, "float"),
    )
}


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == INF


def is_finite(x: Column) -> Column:
    return ~(is_nan(x) | is_infinite(x))


def classify(x: Column, least_normal: float = LEAST_NORMAL_64) -> Column:
    """The class of a number; pass LEAST_NORMAL_32 for 32-bit ones. Null stays null."""
    kind = F.when(is_nan(x), NAN).when(is_infinite(x), INFINITE).when(x == 0, ZERO).when(F.abs(x) < least_normal, SUBNORMAL).otherwise(NORMAL)
    return F.when(x.isNotNull(), kind)


def sanitize(x: Column, fallback: float = 0.0) -> Column:
    """x, or fallback where it isn't finite."""
    return F.when(is_finite(x), x).otherwise(F.when(x.isNotNull(), F.lit(fallback)))


def load(x: Column) -> Column:
    """A stored sample as a working number; what isn't finite becomes 0."""
    return sanitize(x.cast("double"))


def store(x: Column, dtype: str) -> Column:
    """A working number as a sample: integers are rounded half to even and held to the type's bounds, in double precision."""
    d = DTYPES[dtype]
    x = sanitize(x.cast("double"))
    if d.is_float:
        return F.least(F.greatest(x, F.lit(d.low)), F.lit(d.high)).cast("float")
    return F.least(F.greatest(F.rint(x), F.lit(float(d.low))), F.lit(float(d.high))).cast(d.spark)
