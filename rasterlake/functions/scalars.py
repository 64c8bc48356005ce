"""Scalar functions as Column expressions: portable draws, colour, vectors, 8-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def draw(key: Column, salt: int | Column = 0) -> Column:
    """A whole number in [0, PRIME) from a non-negative key below 1e9: the same in every engine with 64-bit integers."""
    salt = F.lit(salt).cast("long") if isinstance(salt, int) else salt.cast("long")
    h1 = (key.cast("long") * 48271 + salt * 16807 + 12345) % PRIME
    h2 = ((h1 * h1 % PRIME) * 69621 + h1) % PRIME
    return ((h2 * h2 % PRIME) * 16807 + h2) % PRIME


def unit(key: Column, salt: int | Column = 0) -> Column:
    """A draw in [0, 1)."""
    return draw(key, salt) / F.lit(float(PRIME))


def uint8(value: Column) -> Column:
    """Clips to 0..255 and cuts off the fraction."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x).otherwise(x / n))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def _linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab of 8-bit sRGB under D65, scaled by 100, 128 and 128."""
    r, g, b = _linear(r), _linear(g), _linear(b)
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    fx, fy, fz = (F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116) for t in (x, y, z))
    return (116 * fy - 16) / 100, 500 * (fx - fy) / 128, 200 * (fy - fz) / 128


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees (0 to 179), saturation and value in 0..255, rounded."""
    hi, lo = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = hi - lo
    hue = F.when(span == 0, 0.0).when(hi == r, 60 * (g - b) / span).when(hi == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    return F.bround(F.when(hue < 0, hue + 360).otherwise(hue) / 2).cast("int") % 180, F.when(hi == 0, 0).otherwise(F.bround(span * 255 / hi).cast("int")), hi.cast("int")


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """8-bit RGB of half degrees, saturation and value."""
    h6, c = h / 30.0, v * s / 255.0
    out = []
    for n in (5, 3, 1):
        k = F.pmod(n + h6, F.lit(6.0))
        out.append(F.bround(v - c * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))).cast("int"))
    return out[0], out[1], out[2]


def affinity(distance: Column, sigma: float, power: float = 1.0) -> Column:
    return F.exp(-F.lit(sigma) * F.pow(distance, F.lit(power)))


def clamp_power(similarity: Column, gamma: float) -> Column:
    return F.pow(F.greatest(similarity, F.lit(0.0)), F.lit(gamma))


def padding(size: Column, multiple: int) -> Column:
    """What a size lacks to a multiple."""
    return F.pmod(-size, F.lit(multiple))


def n_windows(size: Column, crop: int, stride: int) -> Column:
    return F.floor((F.greatest(size - crop + stride - 1, F.lit(0))) / stride) + 1


def percent(value: Column) -> Column:
    """A share as a percentage of two digits, half to even, and back."""
    return F.bround(value * 100, 2) / 100
