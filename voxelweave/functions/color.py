"""Colour, opacity and view-weight expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constant band of spherical harmonics: fixed value.
SH0 = 0.28209479


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sh_dc_color(sh0: Column) -> Column:
    return clamp(SH0 * sh0 + 0.5)


def falloff(d: Column, alpha: Column) -> Column:
    """Opacity of a splat at a squared distance in its own axes; null where it would not show."""
    a = F.exp(-4.5 * d) * alpha
    return F.when(a >= 1 / 255, a)


def linear_to_srgb8(x: Column) -> Column:
    c = clamp(x)
    s = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
    return F.floor(s * 255 + 0.5).cast("int")


def unit_to_u8(x: Column) -> Column:
    return F.floor(clamp(x) * 255 + 0.5).cast("int")


def correct(rgb: tuple[Column, Column, Column], m: list[list[float]] | None) -> tuple[Column, ...]:
    """A 3 x 3 colour matrix; none leaves colours as they are."""
    return rgb if m is None else tuple(sum((F.lit(w) * c for w, c in zip(row, rgb, strict=True)), F.lit(0.0)) for row in m)


def reinhard(x: Column) -> Column:
    return x / (1 + x)


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = clamp((x - a) / (b - a))
    return t * t * (3 - 2 * t)


def view_weight(n_dot_c: Column, c_dot_v: Column) -> Column:
    """View-dependent texture weight: facing the camera, seen from near it, faded out at grazing angles."""
    return n_dot_c * F.greatest(c_dot_v, F.lit(0.0)) * smoothstep(0.0, 0.26, n_dot_c)


def texture_weight(n_dot_c: Column, distance: Column) -> Column:
    """Atlas weight: facing, grazing ramp, and inverse square of the distance."""
    return n_dot_c * F.least(F.lit(1.0), n_dot_c / 0.26) / (1 + distance * distance)


def psnr(mse: Column) -> Column:
    return F.when(mse < 1e-10, F.lit(100.0)).otherwise(-10 * F.log10(mse))


def warmup_cosine(step: Column, steps: Column, rate: float, warmup: int) -> Column:
    """A learning rate that rises over the warm-up and falls along a half cosine."""
    return F.when(step < warmup, rate * (step + 1) / warmup).otherwise(0.5 * rate * (1 + F.cos(3.141592653589793 * (step - warmup) / (steps - warmup))))


def backoff_ms(attempt: Column, first: int = 1000, most: int = 16000) -> Column:
    """Wait before a further attempt: doubled each time, up to a limit."""
    return F.least(F.lit(first) * F.pow(F.lit(2), attempt), F.lit(most)).cast("long")


def quality(fps: Column, latency_ms: Column | None = None) -> Column:
    """good, fair or poor by frames a second, and by latency if it is given; the worse of both."""
    rank = F.when(fps >= 28, 0).when(fps >= 15, 1).otherwise(2)
    if latency_ms is not None:
        rank = F.greatest(rank, F.when(latency_ms < 100, 0).when(latency_ms < 300, 1).otherwise(2))
    return F.element_at(F.array(F.lit("good"), F.lit("fair"), F.lit("poor")), rank + 1)
