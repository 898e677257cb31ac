"""Quantised forms of splat attributes: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelweave.functions.color import clamp


def to_u16(x: Column, low: Column, high: Column) -> Column:
    """Worker form: 16 bits over a range; the middle for a degenerate one."""
    return F.when(high - low < 1e-12, F.lit(32768)).otherwise(F.floor(clamp((x - low) / F.when(high - low >= 1e-12, high - low)) * 65535 + 0.5).cast("int"))


def from_u16(n: Column, low: Column, high: Column) -> Column:
    return low + n / 65535 * (high - low)


def log_scale_u16(s: Column, low: float = -10.0, high: float = 2.0) -> Column:
    """Log of a scale, 16 bits over a fixed range."""
    return to_u16(F.log(F.greatest(s, F.lit(1e-10))), F.lit(low), F.lit(high))


def from_log_scale_u16(n: Column, low: float = -10.0, high: float = 2.0) -> Column:
    return F.exp(from_u16(n, F.lit(low), F.lit(high)))


def quat_i8(q: Column) -> Column:
    """A quaternion component, 8 bits, cut towards zero."""
    return clamp(q * 127, -127.0, 127.0).cast("int")


def to_u8(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.floor(clamp((x - low) / (high - low)) * 255 + 0.5).cast("int")


def spz(x: Column, low: Column, high: Column, top: int) -> Column:
    """Chunk form: rounded half away from zero; 0 for a degenerate range."""
    return F.when(high - low < 1e-12, F.lit(0)).otherwise(F.round(clamp((x - low) / F.when(high - low >= 1e-12, high - low)) * top).cast("int"))


def bits_per_splat(degree: int) -> int:
    """Colour coefficients of a degree: three for each of the (degree + 1) squared bands."""
    return (degree + 1) ** 2 * 3
